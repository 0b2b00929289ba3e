"""Every rule on a text made only of its own match."""

from re import _parser

from modloom.llm import licenses


def sample(parsed):
    """A short text that a pattern matches."""
    text = ""
    for op, value in parsed:
        op = str(op)
        if op == "LITERAL":
            text += chr(value)
        elif op == "NOT_LITERAL":
            text += "."
        elif op == "IN":
            kind, first = value[0]
            text += {"LITERAL": lambda: chr(first), "RANGE": lambda: chr(first[0])}.get(str(kind), lambda: " ")()
        elif op == "BRANCH":
            text += sample(value[1][0])
        elif op == "SUBPATTERN":
            text += sample(value[3])
        elif op == "MAX_REPEAT":
            text += sample(value[2]) * value[0]
    return text


def test_every_rule_fires_on_its_own_match(docs):
    rules = licenses.spaced_rules()
    texts = [sample(_parser.parse(pattern)) for *_, pattern, _ in rules]
    rows = docs(texts).select("doc_id", licenses.detections(licenses.lower_ascii(licenses.text_of())).alias("found"))
    fired = {r.doc_id: {d.rule for d in r.found} for r in rows.collect()}
    assert [texts[i] for i in range(len(rules)) if i not in fired[i]] == []


UNGATED = [
    ("published under CC BY 4.0", "cc-by-4.0"),
    ("CC-BY-SA 4.0", "cc-by-sa-4.0"),
    ("CC0 1.0 Universal", "cc0-1.0"),
    ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"),
    ("released under OpenRAIL", "openrail"),
    ("wtfpl.net", "wtfpl"),
    ("mozilla.org/MPL/2.0", "mpl-2.0"),
    ("scripts.sil.org/OFL", "ofl-1.1"),
    ("eclipse.org/legal/epl-v10", "epl-1.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("This software is proprietary and confidential", "proprietary"),
]


def test_no_gate_word_is_needed(docs):
    rows = {r.doc_id: r for r in licenses.license_report(docs([text for text, _ in UNGATED])).collect()}
    missed = [text for i, (text, label) in enumerate(UNGATED) if label not in rows[i].labels.split(",")]
    assert missed == [] and all(r.score > 0 for r in rows.values())
