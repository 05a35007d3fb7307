"""Each operator against a plain version, on rows with every odd case: nulls, empty and long texts, ties, repeats,
clashing extra columns, and empty tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanweave.llm import chat, classifier, exact, html, jaccard, mixing, packing, quality_rules, substrings, urls, words
from scanweave.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, starts string"


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, 4000, n))


BASE = prose(1, 200)
TEXTS = [
    (1, BASE, "a"), (2, BASE, "a"), (2, BASE, "a"), (3, None, None), (4, "", "b"), (5, "  \n\t ", "b"), (6, "one two", "b"), (7, BASE.upper(), "a"), (8, prose(2) + " " + BASE[:700], "a"),
    (9, BASE + " tail words here", "c"), (10, "x" * 50_000, "c"), (11, prose(3, 20_000), "a"), (12, "naïve été 日本 " * 40, None), (13, "a b c " * 100, "a"), (None, BASE, "a"), (None, None, None),
    (14, "One Two", "b"), (15, "### $$$ *** " * 60, "b"), (16, "same line\n" * 50, "b"), (17, prose(4).replace(" ", "\n"), "d"),
]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "own", 7, "s") for i, t, s in texts], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return rows(spark).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return rows(spark, [])


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


# ---- words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é日\n\t \x0b\x1c\xa0", max_size=30)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    w = words.Words(pa.array(texts, pa.string()))
    got = [bytes(w.buf[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in WORD.findall(t or "")]
    assert w.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    h = w.hashes()
    assert len({*h.tolist()}) == len({*got})


def test_window_hashes_depend_on_words_only():
    w = words.Words(pa.array(["a b c d", "x a b c", None]))
    at, per = w.window_starts(3)
    s = words.running(w.hashes(), words.WORD_BASE)
    h = words.spans(s, at, at + 3, words.WORD_BASE)
    assert per.tolist() == [2, 2, 0] and h[0] == h[3] and len(set(h.tolist())) == 3
    assert words.sliding_min(np.array([5, 3, 4, 1, 2]), 3).tolist() == [3, 1, 1]


def test_slices_cut_between_rows():
    b = pa.RecordBatch.from_pydict({"text": ["a" * 5, "b" * 50, None, "c"]})
    assert [x.num_rows for x in words.slices(iter([b]), "text", 10)] == [1, 1, 2]


# ---- 1: substrings


def plain_repeats(texts, window):
    least = {}
    split = [(i, WORD.findall(t or "")) for i, t, _ in texts]
    key = lambda i: float("inf") if i is None else i
    for i, w in split:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, float("inf")), key(i))
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < key(i):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("window", [50, 5])
def test_substrings_against_plain(docs, window):
    got = substrings.remove_repeats(docs, window=window, with_text=True).collect()
    same([tuple(r)[:4] for r in got], plain_repeats(TEXTS, window))
    for r in got:
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["removed"])
        assert len(WORD.findall(r["kept_text"])) == r["n_words"] - r["n_removed"]


def test_substrings_of_periodic_and_shared_texts(spark):
    base = prose(5, 150).split()
    texts = [(1, "a b " * 200, "s"), (2, "b a " * 120, "s"), (3, " ".join(base), "s")]
    texts += [(k, " ".join([*prose(k + 50, 30).split(), *base[k % 40 : 60 + k % 50], *prose(k + 90, 20).split()]), "s") for k in range(4, 30)]
    same(substrings.remove_repeats(rows(spark, texts), window=20, with_text=False).collect(), plain_repeats(texts, 20))


def test_substrings_empty(none):
    assert substrings.remove_repeats(none).count() == 0


# ---- 2: chat


def test_chat_round_trip_and_parts(spark):
    nasty = ["\\### Assistant: </turn> ok", '</turn>\n<turn role="assistant">', "\\l \\bl \\\\l <>\"", None, "", "<image 1>", "é日\n"]
    data = [(1, k, ("user", "assistant")[k % 2], t, "x") for k, t in enumerate(nasty)] + [(None, None, None, "t", "x"), (2, 0, "assistant", "b", "x"), (2, 0, "assistant", "a", "x"), (2, 0, "assistant", "a", "x")]
    m = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    from pyspark.sql import functions as F

    out = chat.format_chats(m.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r["conv_id"]: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(("user", "assistant")[k % 2], t or "") for k, t in enumerate(nasty)]
    assert got[1]["loss"] == "".join((t or "") for t in nasty[1::2])
    assert [t["text"] for t in got[2]["turns"]] == ["a", "a", "b"] and got[2]["loss"] == "aab"
    assert got[None]["n_turns"] == 1 and got[None]["loss"] == ""


def test_chat_attachments(spark):
    parts = [{"type": "text", "text": "see <", "ref": None, "units": None}, {"type": "image", "text": None, "ref": "a.png", "units": 3.0}, {"type": "audio", "text": None, "ref": "b.wav", "units": 1.5}, {"type": None, "text": "!", "ref": None, "units": None}, {"type": "document", "text": None, "ref": "c.pdf", "units": None}]
    m = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(m).first()
    assert r["formatted"] == '<turn role="user">see \\l<image 1><audio 2>!<document 3></turn>\n<turn role="assistant"></turn>\n'
    assert [(a["turn"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "a.png", 768), (0, "audio", "b.wav", 38), (0, "document", "c.pdf", 600)]
    assert r["attachment_tokens"] == 1406 and [(s["start"], s["length"]) for s in r["loss_spans"]] == [(len(r["formatted"]) - 8, 0)]


def test_chat_empty(spark):
    m = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.format_chats(m).count() == 0


# ---- 3: exact


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_against_plain(docs, keep):
    pick = max if keep == "largest" else min
    groups = {}
    for i, t, _ in TEXTS:
        groups.setdefault(t or "", []).append(i)
    best = {t: (pick([i for i in g if i is not None]) if any(i is not None for i in g) else None) for t, g in groups.items()}
    got = exact.exact_copies(docs, keep=keep).collect()
    same([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], [(i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in TEXTS])
    kept = [r for r in got if r["kept"]]
    same([(r["doc_id"], r["text_sha256"]) for r in kept], [(b, hashlib.sha256(t.encode()).hexdigest()) for t, b in best.items()])
    left = exact.drop_copies(docs, keep=keep)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_exact_hot_group_spreads(spark):
    """One text in a third of all rows crosses partitions: ids of it are still one group."""
    d = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id) end as text").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact.exact_copies(d, keep="smallest").filter("text_sha256 = sha2('hot', 256)").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 1000 and {r["group_size"] for r in got} == {1000} and [r["doc_id"] for r in got if r["kept"]] == [0] and {r["keep_id"] for r in got} == {0}


def test_exact_normalises(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, "A b"), (2, "a B")], "doc_id long, text string")
    assert {r["group_size"] for r in exact.exact_copies(d, normalise=F.lower).collect()} == {2}


def test_exact_empty(none):
    assert exact.exact_copies(none).count() == 0 and exact.drop_copies(none).count() == 0


# ---- 4: mixing


def plain_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        level = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if level[s] > cap * sizes[s]]
        if not over:
            return capped | level
        for s in over:
            capped[s] = cap * sizes[s]
            left -= capped[s]


def test_mixing_targets_and_copies(docs):
    sizes = Counter()
    for _, t, s in TEXTS:
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    got = mixing.mix(docs).select("doc_id", "source", "text", "mix.*").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and r["copies"] - int(r["rate"]) in (0, 1) and r["copies"] <= 2
    out = mixing.emit_copies(mixing.mix(docs))
    assert out.count() == sum(r["copies"] for r in got) and set(docs.columns) <= set(out.columns)
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in mixing.mix(docs).select("doc_id", "mix.*").collect()}


def test_mixing_comes_near_targets(spark):
    d = spark.range(20_000).selectExpr("id as doc_id", "concat('s', if(id % 3 = 0, 0, id % 7)) as source", "repeat('w ', cast(1 + id % 50 as int)) as text")
    r = mixing.mix(d).groupBy("source").agg({"mix.target": "first"}).count()
    rows_ = mixing.mix(d).selectExpr("source", "mix.target", "mix.size * mix.copies as taken").groupBy("source", "target").sum("taken").collect()
    assert r == 7 and all(abs(x["sum(taken)"] - x["target"]) < 0.05 * x["target"] for x in rows_)


def test_mixing_empty(none):
    assert mixing.mix(none).count() == 0 and mixing.emit_copies(mixing.mix(none)).count() == 0


# ---- 5: rules


def plain_counts(t):
    t = t or ""
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rules_counts_and_verdicts(docs):
    got = quality_rules.judge(docs, ["doc_id"], counts=True).collect()
    want = []
    for i, t, _ in TEXTS:
        n, chars, sym, dup, rep = plain_counts(t)
        want.append((i, n, chars, sym, dup, rep, n < 50 or 100 * rep > 50 * n))
    same([tuple(r)[:1] + tuple(r)[2:] for r in got], want)
    for r in got:
        assert not r["base_failed"] or r["rejected_by"]
    left = quality_rules.drop_rejected(docs)
    assert left.schema == docs.schema and left.count() == sum(r["rejected_by"] is None for r in got)
    plain = quality_rules.judge(docs, ["doc_id"]).collect()
    same([(r["doc_id"], r["rejected_by"] is None) for r in plain], [(r["doc_id"], r["rejected_by"] is None) for r in got])


def test_rules_order_does_not_change_verdicts(docs):
    other = quality_rules.judge(docs, ["doc_id"], rules=quality_rules.RULES[::-1]).collect()
    first = quality_rules.judge(docs, ["doc_id"]).collect()
    same([(r[0], r[1] is None) for r in first], [(r[0], r[1] is None) for r in other])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab\n |é", max_size=60)), min_size=1, max_size=6))
def test_rules_counts_by_property(texts):
    p = quality_rules.Page(words.Words(pa.array(texts, pa.string())))
    got = list(zip(p.n_words.tolist(), p.word_chars.tolist(), p.n_symbols.tolist(), p.lines[1].tolist(), p.n_repeat_words.tolist(), strict=True))
    assert got == [plain_counts(t) for t in texts]


def test_rules_empty(none):
    assert quality_rules.judge(none, ["doc_id"], counts=True).count() == 0 and quality_rules.drop_rejected(none).count() == 0


# ---- 6: jaccard


def plain_components(texts, k, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, _ in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for a, (i, _, _) in enumerate(texts):
        r = find(a)
        low[r] = min(low.get(r, float("inf")), float("inf") if i is None else i)
    return [(i, len(sets[a]), None if low[find(a)] == float("inf") else low[find(a)]) for a, (i, _, _) in enumerate(texts)]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_against_plain(docs, k, percent):
    got = jaccard.near_components(docs, k=k, percent=percent).collect()
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], plain_components(TEXTS, k, percent))


@pytest.mark.parametrize("small", [2, 16, None])
def test_jaccard_near_group(spark, monkeypatch, small):
    """Near copies of one text with edits of many sizes, in blocks of two sizes and as pairs."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = prose(9, 100).split()
    texts = []
    for i in range(60):
        w = list(base)
        for j in rng.integers(0, len(w), rng.integers(0, 9)):
            w[j] = f"e{i}x{j}"
        texts.append((100 + i, " ".join(w), "s"))
    texts += [(i, prose(200 + i, 60) + " " + " ".join(base[:20]), "s") for i in range(20)]
    got = jaccard.near_components(rows(spark, texts), small_group=small).collect()
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], plain_components(texts, 4, 85))


def test_jaccard_stage_keeps_one_of_each(docs):
    left = jaccard.drop_near_copies(docs)
    want = {c if n else (i, j) for j, (i, n, c) in enumerate(plain_components(TEXTS, 4, 85)) if n}
    empty = {(i, t or "") for i, t, _ in TEXTS if not WORD.search(t or "")}
    assert left.columns == docs.columns and left.count() == len(want) + len(empty)


def test_jaccard_empty(none):
    assert jaccard.near_components(none).count() == 0 and jaccard.drop_near_copies(none).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (5, 5), (20, 30), (30, 25), *((100 + k, 101 + k) for k in range(40))]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 20: 20, 25: 20, 30: 20, **{100 + k: 100 for k in range(41)}}


# ---- 7: urls

URLS = [
    (1, "https://a.example.com/en/x?y#z"), (2, "HTTP://WWW.Example.COM/en/"), (3, "http://x.net/es/1"), (4, "http://x.net/de/1"), (5, None), (6, "no scheme"), (7, "http://notexample.com/en/1"),
    (8, "http://example.com"), (9, "https://free-casino-bets.org/poker"), (10, "https://library.org/books/" + "a" * 30_000), (11, ""), (12, "http://x.net/fr/?a"), (13, "http://com/"),
]


def test_urls(spark):
    d = spark.createDataFrame([(i, u, "r") for i, u in URLS], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in urls.judge_urls(d, ["page_id"]).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert (got[2]["host"], got[2]["rule"], got[2]["verdict"]) == ("www.example.com", "www.example.com/en/", "allow")
    assert got[3]["rule"] == "net/es/" and got[12]["rule"] == "net/fr/" and got[4]["rule"] is None and got[7]["rule"] == "com/" and got[8]["rule"] is None and got[13]["rule"] == "com/"
    for k in (5, 6, 11):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == ("", "", None, "allow")
    assert got[9]["verdict"] == "block" and got[10]["verdict"] == "allow" and got[1]["score"] is None
    assert urls.judge_urls(d.limit(0), ["page_id"]).count() == 0


def test_url_model_learns_its_table():
    model = urls.train()
    score = lambda us: model.score(*(pa.array([u[k] for u in us]) for k in (0, 1)))
    assert (score(urls.labelled(urls.BLOCKED)) >= 0.5).mean() > 0.9 and (score(urls.labelled(urls.ALLOWED)) < 0.5).mean() > 0.98


# ---- 8: html

PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class='cookie-notice'>We use cookies</div>"
    "<article><header><h1>Title &amp; more</h1></header><p>First paragraph   with\n<b>bold</b> &lt;text&gt; and enough words to be read.<p>Be.<script>var a='</p>'</script>"
    "<form><input><label>Mail</label></form><p>Another long paragraph, which says quite a few things.<br>After the break.</p><section id=comments><p>I liked this a lot, thank you for writing it.</p></section></article>"
    "<aside>Related</aside><div class=sidebar>Side</div><footer>Foot</footer></body></html>"
)
MAIN = "Title & more\nFirst paragraph with bold <text> and enough words to be read.\nBe.\nAnother long paragraph, which says quite a few things.\nAfter the break."


def test_html_main_text():
    assert html.main_text(PAGE) == MAIN
    assert html.main_text(PAGE.replace("<article>", "<div id=content>").replace("</article>", "</div>").replace("<header><h1>Title &amp; more</h1></header>", "<h1>Title &amp; more</h1>")) == MAIN
    assert html.main_text(PAGE.replace("</article>", "").replace("</body></html>", "")) == MAIN
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == "" and html.main_text("plain words") == "plain words"


def test_html_operator(spark):
    d = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (2, None, None, "t"), (3, "u", "<p>" + "long " * 40_000, "t")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html.extract(d, ["page_id", "url"]).collect()}
    assert got[1]["text"] == MAIN and got[1]["n_chars"] == len(MAIN) and got[2]["n_chars"] == 0 and got[3]["n_chars"] == 5 * 40_000 - 1
    assert html.extract(d.limit(0), ["page_id"]).count() == 0


# ---- 9: packing


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    got = packing.pack(docs, packing.default_tokenizer()).collect()
    want = Counter(tuple(t.encode(x or "", add_special_tokens=False).ids + [2]) for _, x, _ in TEXTS)
    parts, seqs = {}, {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault((r["doc_id"], r["piece"]), []).append(r)
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == __import__("zlib").crc32(np.array(r["ids"], "<u4").tobytes())
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    assert sum(r["length"] for r in got) == sum(len(k) * n for k, n in want.items())
    by_start = sorted((r for r in got if r["doc_id"] == 11), key=lambda r: r["piece"])
    assert [i for r in by_start for i in r["ids"]] == t.encode(dict((i, x) for i, x, _ in TEXTS)[11], add_special_tokens=False).ids + [2]
    assert all(r["length"] == 1024 for r in by_start[1:])


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    f = packing.BestFit(10, 2)
    assert [f.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    f = packing.BestFit(10, 2)
    assert [f.place(n) for n in (6, 8, 7, 2)] == [(0, 0), (1, 0), (2, 0), (2, 7)]
    assert packing.pieces_of(2500) == [(0, 452), (452, 1024), (1476, 1024)] and packing.pieces_of(2048) == [(0, 1024), (1024, 1024)] and packing.pieces_of(3) == [(0, 3)]


def test_packing_empty(none):
    assert packing.pack(none, packing.default_tokenizer()).count() == 0


# ---- 10: classifier


def test_classifier(spark):
    good = [(i, prose(i, 80), 1) for i in range(0, 300)]
    bad = [(i, prose(i, 80).replace(" ", "!! ").upper(), 0) for i in range(300, 600)]
    d = rows(spark, [(i, t, "s") for i, t, _ in good + bad] + [(1000, None, "s"), (1001, "", "s"), (1000, None, "s"), (None, "odd", "s")]).repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (5, None), (1, 1), (9999, 0)], "doc_id long, quality int")
    features, net = classifier.fit(d, labels)
    got = classifier.score(d, features, net, ["doc_id"]).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: q for i, _, q in good + bad}
    test = [(r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and classifier.held_out(r["doc_id"])]
    assert len(test) > 100 and np.mean(test) > 0.95
    again = classifier.score(d.repartition(5), *classifier.fit(d.repartition(5), labels), ["doc_id"]).collect()
    assert {(r[0], r[1]) for r in got} == {(r[0], r[1]) for r in again}


def test_classifier_without_labels(docs, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = classifier.score(docs, *classifier.fit(docs, labels), ["doc_id"]).collect()
    assert len(got) == len(TEXTS) and {r["score"] for r in got} == {0.5}
    assert classifier.score(none, *classifier.fit(none, labels), ["doc_id"]).count() == 0


def test_held_out_is_the_same_on_both_sides(spark):
    from pyspark.sql import functions as F

    for r in spark.range(50).select("id", classifier.held_out_ids(F.col("id")).alias("h")).collect():
        assert r["h"] == classifier.held_out(r["id"])
