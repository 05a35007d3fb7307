"""What earlier versions left out: parts of pages, links between near copies, and so on."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scanweave.llm import html

from .test_operators import WORD, prose, rows


# ---- 8: html

LONG = "This is a long paragraph of plain words that goes on for a while so that it counts as content."


def paragraphs(n):
    return "".join(f"<p>{LONG} {LONG} {LONG}</p>" for _ in range(n))


def around(inner):
    return f"<body><div><a href=1>One</a> <a href=2>Two</a></div>{inner}<div><a href=3>Imprint</a></div></body>"


def test_html_blocks_of_one_container():
    many = "\n".join([f"{LONG} {LONG} {LONG}"] * 4)
    got = html.main_text(around(f"<div id=content><h1>T</h1><p>intro</p><section>{paragraphs(4)}</section><section><h2>Next</h2><p>{LONG}</p></section></div>"))
    assert got == f"T\nintro\n{many}\nNext\n{LONG}"
    assert html.main_text(around(f"<div id=content><p>Before.</p><ul>{f'<li>{LONG}</li>' * 6}</ul><p>After.</p></div>")) == "\n".join(["Before.", *[LONG] * 6, "After."])
    assert html.main_text(around(f"<div id=content><p>Before.</p><table>{f'<tr><td>{LONG}</td></tr>' * 6}</table><p>After.</p></div>")) == "\n".join(["Before.", *[LONG] * 6, "After."])
    assert html.main_text(around(f"<div id=content><h1>T</h1><div>{paragraphs(4)}</div><div>tail</div></div>")) == f"T\n{many}\ntail"


def test_html_content_in_and_beside_articles():
    many = "\n".join([f"{LONG} {LONG} {LONG}"] * 4)
    got = html.main_text(f"<body><div id=content><h1>T</h1>{paragraphs(4)}</div><div><article><h3>Teaser</h3><p>{LONG} {LONG}</p></article></div></body>")
    assert got.startswith(f"T\n{many}\n")
    assert html.main_text(around(f"<div><article><h2>A</h2>{paragraphs(4)}</article><article><h2>B</h2><p>Short.</p></article></div>")) == f"A\n{many}\nB\nShort."


def test_html_menus_stay_out():
    assert html.main_text(around(f"<div id=content>{paragraphs(2)}</div>")) == "\n".join([f"{LONG} {LONG} {LONG}"] * 2)
    assert html.main_text(f"<body><main><h1>T</h1>{paragraphs(2)}</main><div><p>{LONG}</p></div></body>") == "\n".join(["T", *[f"{LONG} {LONG} {LONG}"] * 2])


# ---- 6: links


def plain_links(texts, k, percent):
    """(id, least id of the rows with the same set, number of other rows that link to it) of each row."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, _ in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]))
    out = []
    for a, (i, _, _) in enumerate(texts):
        same = [texts[b][0] for b in range(len(texts)) if sets[b] == sets[a]] if sets[a] else [i]
        n = sum(bool(sets[a]) and a != b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) for b in range(len(texts)))
        out.append((i, min((x for x in same if x is not None), default=None), n))
    return out


def group_of_near_copies():
    """60 edits of one text, some of them twice, others with the same words in capitals, and looser relatives."""
    rng = np.random.default_rng(3)
    base = prose(9, 300).split()
    texts = []
    for i in range(60):
        w = list(base)
        for j in rng.integers(0, len(w), rng.integers(0, 9)):
            w[j] = f"e{i}x{j}"
        texts.append((100 + i, " ".join(w), "s"))
    texts += [(300 + i, texts[3 * i][1], "s") for i in range(5)] + [(400 + i, texts[7 * i][1].upper(), "s") for i in range(5)]
    return texts + [(i, prose(200 + i, 60) + " " + " ".join(base[:20]), "s") for i in range(20)] + [(None, " ".join(base), "s"), (500, "", "s"), (501, None, "s")]


@pytest.mark.parametrize("small,block", [(2, 8), (16, 256), (None, 8)])
def test_links_of_a_large_group(spark, monkeypatch, small, block):
    from scanweave.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = group_of_near_copies()
    full = jaccard.near_components(rows(spark, texts), links=True, small_group=small)
    got = full.select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == Counter(plain_links(texts, 4, 85))
    assert max(r["n_links"] for r in got) > 20
    cols = ["doc_id", "n_shingles", "component_id", "first"]
    assert Counter(map(tuple, full.select(cols).collect())) == Counter(map(tuple, jaccard.near_components(rows(spark, texts), small_group=small).select(cols).collect()))


def test_links_of_odd_rows(spark):
    from scanweave.llm import jaccard

    from .test_operators import TEXTS

    got = jaccard.near_components(rows(spark, TEXTS), k=1, percent=50, links=True).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == Counter(plain_links(TEXTS, 1, 50))
    assert jaccard.near_components(rows(spark, []), links=True).count() == 0


# ---- pipeline: clean texts with a short line twice


def test_pipeline_keeps_a_text_with_a_short_line_twice(spark):
    import corpus_pipeline

    texts = [(1, f"Yes.\n{prose(5, 80)}\nYes.", "s"), (2, (prose(6, 60) + "\n") * 2 + prose(7, 60), "s"), (3, prose(8, 80), "s")]
    assert sorted(r["doc_id"] for r in corpus_pipeline.quality_rules(spark, rows(spark, texts), "").collect()) == [1, 3]


# ---- 9: added tokens in texts


def test_added_tokens_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    from scanweave.llm import packing
    from scanweave.llm.tokens import encoder

    path = packing.default_tokenizer()
    texts = ["plain words here", "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|><|endoftext|>  \n y", None, "<|endoftext"]
    library = Tokenizer.from_file(path)
    got = [ids.tolist() for ids in encoder(path).encode(pa.array(texts))]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts] and 50256 in got[1]
