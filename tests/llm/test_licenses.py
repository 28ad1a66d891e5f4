import re

from veilshift.llm.licenses import TEMPLATES, THRESHOLD, op7_licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def brute(text):
    t = (text or "").translate(LOWER)
    w = WORD.findall(t)
    places = sorted((i, name) for p, name in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
    parts = []
    for b in re.split(r"[.!?][\x09-\x0D\x20]|\n", t):
        have = set(WORD.findall(b))
        for label, x in TEMPLATES:
            of = set(x.split())
            if len(of & have) >= THRESHOLD * len(of):
                parts.append((label, len(of & have) / len(of)))
    base = {n for _, n in places}
    return (
        len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None,
        ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in parts})), 1.0 if places else max((p for _, p in parts), default=0.0),
    )


TEXTS = [
    None, "", "Released under the MIT License.", "mit\nLICENSE, Apache--License general  public license mit license",
    "Licensed under CC BY-NC 4.0.", "licensed under cc by-nc 4.0 and under CC BY-SA 4.0!", "İ MİT LİCENSE K license", "commit license", "mit licenses",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public\nLicense",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. x", "4 0 nc by cc under", "by by by nc nc under under 4 0",
    "w " * 60_000 + "the work is licensed under the GNU Affero General Public License", "Licensed under CC BY-NC 4.0.", "Releaſed under the MIT", "é" * 10 + " ²x_y3Z",
]


def test_equals_brute_force(spark, tmp_path):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "x"), (3, TEXTS[3], "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, label string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op7_licenses(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t, _ in rows), key=repr)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op7_licenses(spark, str(tmp_path)).count() == 0


def test_wrapped_notices(spark, tmp_path):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mit = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated files"
    gap = "Redistribution and use in source and binary forms\n\nwith or without modification are permitted"
    far = "\n".join(f"{w} " + "x " * 30 for w in "licensed under the gnu affero general license public".split())
    rows = [(0, bsd), (1, mit), (2, "w\n" * 97 + bsd.replace(" ", "\n")), (3, gap), (4, far)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.labels, r.score) for r in op7_licenses(spark, str(tmp_path)).collect()}
    assert got == {0: ("bsd", 1.0), 1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("", 0.0), 4: ("", 0.0)}
