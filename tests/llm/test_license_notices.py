"""Licenses named by their own text or by a short name."""

import pytest

from lodestone.llm import licenses

NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and ..."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("as-is", "The software is provided \"as is\", without warranty of any kind"),
    ("gpl-3", "GPL v3"), ("gpl-3", "It is GPLv3 only"), ("lgpl-2.1", "see LGPL 2.1"), ("apache-2", "Apache-2.0"), ("apache-2", "the Apache 2.0 license"), ("bsd", "a BSD license"), ("bsd-2", "2-clause BSD"),
]


def test_op8_notices_and_short_names(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(NOTICES)] + [(99, "Nothing of the kind, mpla gplx")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [got[i].labels for i in range(len(NOTICES))] == [x for x, _ in NOTICES] and got[99].labels == ""
    assert all(got[i].score > 0 for i in range(len(NOTICES)))


@pytest.mark.parametrize("rule", licenses._SIGNATURES, ids=lambda r: r[1][:30])
def test_op8_keyword_starts_a_word_of_its_signature(rule):
    """A text that a signature fits must pass the keyword filter."""
    words = [w for w in rule[1].replace("|", " ").replace("(", " ").replace(")", " ").replace("[", " ").replace("]", " ").split()]
    assert any(w.startswith(rule[2]) for w in words) and rule[2]
