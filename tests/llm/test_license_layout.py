"""Standard headers as they are wrapped in source files."""

from modloom.llm import licenses

FSF = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version."""
CASES = [
    (FSF.format("", "3"), "gpl,gpl-3.0"),
    (FSF.format("", "2").replace("Foundation,", "Foundation;"), "gpl,gpl-2.0"),
    (FSF.format("Lesser ", "3"), "gpl,lgpl-3.0"),
    (FSF.format("Lesser ", "2.1"), "gpl,lgpl-2.1"),
    (FSF.format("Library ", "2"), "gpl,lgpl-2.0"),
    ("it under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", "gpl,gpl-2.0"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee", "isc"),
    ("Apache License\nVersion 2.0, January 2004", "apache,apache-2.0"),
    ("Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software", "mit"),
    ("Copyright (c) 2020, Someone.\nAll rights reserved.", "all-rights-reserved"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "gpl,gpl-3.0"),
    ("The GNU General Public License\n2. Something else", "gpl"),
]


MARKS = ["", " * ", "# ", "// ", "   ", ";; "]


def test_wrapped_headers(docs):
    made = [(mark, text, labels) for mark in MARKS for text, labels in CASES]
    texts = ["\n".join(mark + line for line in text.split("\n")) for mark, text, _ in made]
    rows = {r.doc_id: r.labels for r in licenses.license_report(docs(texts)).collect()}
    assert [(texts[i], rows[i]) for i in range(len(made)) if rows[i] != made[i][2]] == []
