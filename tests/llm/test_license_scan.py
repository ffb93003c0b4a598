import textwrap
from difflib import SequenceMatcher

import pytest
import zstandard

from ruleweave.llm import license_scan as ls
from ruleweave.llm import license_texts


def scan(text):
    return [(at, f.n_lines, f.license, f.verdict) for at, f in ls.scanner().scan(text, {})]


@pytest.mark.parametrize("name,text", [(n, t) for n, ts in ls.TEMPLATES.items() for t in ts])
def test_every_template_finds_itself_wrapped_and_between_prose(name, text):
    wrapped = "\n".join(textwrap.wrap(text, 72))
    for said in (text, text.upper().rstrip("."), "  " + text.replace(",", "") + " ", wrapped):
        found = scan(f"Some prose of no interest here.\n{said}\nAnd other prose after it.")
        assert any((f[2], f[3]) == (name, "exact") and f[1] == len(said.split("\n")) for f in found), (said, found)


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("width", [20, 25, 36, 50, 76, 100])
def test_every_text_is_found_at_any_width_and_behind_comment_marks(width, mark):
    for name, texts in ls.TEMPLATES.items():
        for text in texts:
            lines = [mark + line for part in text.split("\n") for line in textwrap.wrap(part, width) or [""]]
            found = scan("Some words before it.\n" + "\n".join(lines) + "\nand after it some more.")
            assert any(f[2] == name for f in found), (name, text[:40], found)


@pytest.mark.parametrize("name", sorted(license_texts.whole_texts()))
def test_whole_long_texts_and_their_wrapped_copies(name):
    text = license_texts.whole_texts()[name]
    assert any(f[2:] == (name, "exact") for f in scan(text))
    wrapped = "\n".join("; " + line for line in textwrap.wrap(text, 45))
    assert any(f[2:] == (name, "exact") and f[1] > 100 for f in scan("before\n" + wrapped + "\nafter"))


def test_statements_are_found_and_others_are_not():
    for name, texts in license_texts.statements().items():
        for text in texts:
            assert (name, "exact") in [f[2:] for f in scan(text)], text
    for text, name in (
        ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
        ("This project is licensed under the\n# MIT License.", "MIT"), ("provided without any express or\n# implied warranty", None), ("Licensed under the Foo License.", None),
    ):
        assert [f[2] for f in scan(text)] == [name], text


def test_full_texts_with_small_changes_are_variants():
    for name, texts in ls.TEMPLATES.items():
        text = max(texts, key=len)
        if len(text) > 400:
            said = text.replace("software", "library").replace("files", "data")
            found = scan("\n".join(textwrap.wrap(said, 60)))
            assert any(f[2] == name and f[3] in ("variant", "exact") for f in found), (name, found)


def test_reductions_are_those_of_a_raw_dictionary():
    line = "Licensed under the Apache License, Version 2.0."
    alone, order = ls.Scanner(more=False).ranked(line)
    assert alone == len(zstandard.ZstdCompressor(level=ls.LEVEL, write_content_size=False).compress(line.encode()))
    by = dict((k, n) for n, k in order)
    for k, t in enumerate(t for ts in ls.TEMPLATES.values() for t in ts):
        d = zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        assert by[k] == len(zstandard.ZstdCompressor(level=ls.LEVEL, dict_data=d, write_content_size=False).compress(line.encode()))
    assert order[0][0] < alone


def test_wording_differences_decide():
    scan = ls.scanner().line
    found = scan("This book is licensed under the GNU General Public License, version 3.")
    assert (found.license, found.verdict, found.differences) == ("GPL-3.0", "variant", ("-work +book",))
    assert scan("Licensed under the Apache License, Version 1.1.").verdict == "unmatched"
    assert scan("Licensed under CC BY-NC 3.0.").verdict == "unmatched"
    assert scan("A driver's licence is needed here.").verdict == "unmatched"
    assert scan("Some prose first, and more. Released under the MIT License. And then more prose.").license == "MIT"
    assert scan("word " * 5000 + ". Released under the MIT License. " + "word " * 5000).verdict == "exact"


def test_no_template_has_fewer_differences_than_the_one_found():
    """Brute force over all templates, without the bound that leaves some out."""
    every = ls.scanner()
    lines = [t.replace("licensed", "published").replace("work", "text") for ts in ls.TEMPLATES.values() for t in ts if len(t) < 300]
    for line in lines:
        said = ls.wording(line)
        edits = lambda words: sum(max(b - a, d - c) for op, a, b, c, d in SequenceMatcher(None, words, said, autojunk=False).get_opcodes() if op != "equal")
        assert every.compared(line).n_edits == min(edits(words) for _, words in every.templates)


def test_unconfirmed_lines_have_no_license():
    assert scan("All rights reserved.") == [(0, 1, None, "unmatched")]
    assert ls.scanner().line("All rights reserved.").nearest is not None
    long = ls.scanner().line("licence " + "word " * 100_000)
    assert long.license is None and long.nearest is None and long.verdict == "unmatched"


def test_operator_over_all_lines(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a\nReleased under the MIT License.\nb\nLicensed under CC BY 4.0.", "x"), (3, "no mention", "x"), (None, "Released under the MIT License.", "x"), (None, "Released under the MIT License.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")
    got = sorted((r.doc_id or -1, r.line_no, r.license, r.verdict) for r in ls.scan(docs).collect())
    assert got == [(-1, 0, "MIT", "exact")] * 2 + [(3, 1, "MIT", "exact"), (3, 3, "CC-BY-4.0", "exact")]
    assert ls.scan(docs.limit(0)).count() == 0
    assert {r.n_lines for r in ls.scan(docs.withColumnRenamed("line", "license")).collect()} == {1}
