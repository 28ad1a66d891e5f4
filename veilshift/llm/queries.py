"""The queries of this package and the SQL that some of them equal."""

from __future__ import annotations

from .chats import SQL as CHATS_SQL
from .chats import op8_chats
from .licenses import SQL as LICENSES_SQL
from .licenses import op7_licenses
from .media import op2_media
from .mixing import SQL as MIXING_SQL
from .mixing import op1_mixing
from .neardup import op9_near_duplicates
from .packing import op4_packing
from .quality import op3_quality
from .secrets import op10_secrets
from .substrings import op6_substrings
from .toxicity import op5_toxicity


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_mixing": op1_mixing,
        "op2_media": op2_media,
        "op3_quality": op3_quality,
        "op4_packing": op4_packing,
        "op5_toxicity": op5_toxicity,
        "op6_substrings": op6_substrings,
        "op7_licenses": op7_licenses,
        "op8_chats": op8_chats,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_secrets": op10_secrets,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": MIXING_SQL, "op7_licenses": LICENSES_SQL, "op8_chats": CHATS_SQL}
