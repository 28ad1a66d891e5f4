"""A schema's fingerprint: a hash of its names, kinds, nullability and keys, whatever order they come in."""

from __future__ import annotations

import hashlib
import json

from ..model import Schema


def canonical_text(schema: Schema) -> str:
    """Lengths, precisions and comments don't count. The format is fixed: stored fingerprints depend on it."""
    flag = lambda b: "true" if b else "false"
    names = lambda columns: f"[{', '.join(columns)}]"
    lines = []
    for t in sorted(schema.tables, key=lambda t: t.ref.name):
        lines.append(f"TABLE:{t.ref.name}")
        lines += [f"  COL:{c.name}:{c.type.kind.value}:{flag(c.nullable)}:{flag(c.key)}" for c in sorted(t.columns, key=lambda c: c.name)]
        lines.append(f"  PK:{','.join(t.key)}")
    order = sorted(schema.foreign_keys, key=lambda f: (f.child.name, f.parent.name, f.child_columns, f.parent_columns))
    lines += [f"FK:{f.child.name}{names(f.child_columns)}->{f.parent.name}{names(f.parent_columns)}" for f in order]
    return "".join(f"{x}\n" for x in lines)


def fingerprint(schema: Schema) -> str:
    return "sha256:" + hashlib.sha256(canonical_text(schema).encode()).hexdigest()


def cache_key(schema: Schema, settings: dict) -> str:
    """A plan depends on overrides and thresholds too, so a cached one is found by both."""
    return fingerprint(schema) + "-" + hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]
