"""Quality rules as a short-circuit cascade (operator 5).

Each rule's cost and rejection rate are estimated on a sample of the documents; rules then run in order of rejection
per cost, and a rule sees only what the earlier ones left. A cost is the number of array elements that the rule's counts
go over, so that reruns order the rules alike. The verdict is the conjunction of all rules, so it does not depend on
the order, and an estimate that is off costs time only. A text is cut into words once: what is left after a rejection
is moved together, with the counts that are there already.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; lines are split at \\n; a line counts if it has a word.
Repeats are found by 64-bit hashes within one document.

Edge cases: a null or empty text has no words and is rejected for its length; texts are read whole, however long;
repeated rows are judged each on their own; a null identifier passes through; an empty table gives no rows;
`drop_rejected` keeps all columns, whatever their names; a result of `judge` whose name a key has gets an underscore
behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import beside_keys, table
from .words import BYTE_BASE, WORD_BASE, U, Words, mix, running, slices, spans

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: Part of the documents that estimates are made on, by a seeded sample of all of them, and their least number.
SAMPLE, SAMPLE_ROWS = 0.01, 2000


class Page:
    """Counts per document of a batch of texts, each made when first asked for."""

    def __init__(self, words: Words):
        self.words = words

    def only(self, keep: np.ndarray) -> Page:
        """The documents marked in `keep`, with the counts made so far."""
        out = Page(self.words.only(keep))
        for name in PER_DOCUMENT & self.__dict__.keys():
            got = self.__dict__[name]
            out.__dict__[name] = tuple(x[keep] for x in got) if isinstance(got, tuple) else got[keep]
        return out

    def _sum(self, flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags)])
        return run[self.words.doc_bytes[1:]] - run[self.words.doc_bytes[:-1]]

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.words.counts

    @cached_property
    def word_chars(self) -> np.ndarray:
        w = self.words
        run = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
        return np.bincount(w.doc_of_word(), run[w.end] - run[w.start], len(w.counts)).astype(np.int64)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._sum(SYMBOL[self.words.buf])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._sum(UPPER[self.words.buf])

    @cached_property
    def n_letters(self) -> np.ndarray:
        return self._sum(LETTER[self.words.buf])

    @cached_property
    def _every_line(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, bytes, equal to an earlier one of the document) of each line with a word."""
        w = self.words
        n = len(w.buf)
        breaks = np.flatnonzero(w.buf == 10)
        lo = np.unique(np.concatenate([w.doc_bytes[:-1][np.diff(w.doc_bytes) > 0], breaks[breaks + 1 < n] + 1]))
        doc = np.searchsorted(w.doc_bytes, lo, "right") - 1
        # a line ends before its break, or at its document's end
        hi = np.minimum(np.append(breaks, n)[np.searchsorted(breaks, lo)], w.doc_bytes[doc + 1])
        full = np.searchsorted(w.start, hi) > np.searchsorted(w.start, lo)
        lo, hi, doc = lo[full], hi[full], doc[full]
        sums = running(w.buf.astype(U) + U(1), BYTE_BASE)
        key = mix(mix(spans(sums, lo, hi, BYTE_BASE) + (hi - lo).astype(U)) + doc.astype(U))
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(doc), bool)
        again[first] = False
        return doc, hi - lo, again

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(n_lines with a word, those equal to an earlier one)."""
        doc, _, again = self._every_line
        return tuple(np.bincount(d, minlength=len(self.words.counts)) for d in (doc, doc[again]))

    @cached_property
    def line_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The same in bytes."""
        doc, size, again = self._every_line
        return tuple(np.bincount(d, x, len(self.words.counts)).astype(np.int64) for d, x in ((doc, size), (doc[again], size[again])))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in a window of 3 words that the document has at least twice."""
        w = self.words
        at, _ = w.window_starts(3)
        doc = w.doc_of_word()
        if not len(at):
            return np.zeros(len(w.counts), np.int64)
        sums = running(w.hashes(), WORD_BASE)
        key = mix(mix(spans(sums, at, at + 3, WORD_BASE)) + doc[at].astype(U))
        order = np.argsort(key)
        s = key[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hits = at[twice]
        edge = np.bincount(hits, minlength=len(w) + 1) - np.bincount(hits + 3, minlength=len(w) + 1)
        return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(w.counts))


PER_DOCUMENT = {"n_words", "word_chars", "n_symbols", "n_upper", "n_letters", "lines", "line_bytes", "n_repeat_words"}


@dataclass(frozen=True)
class Rule:
    """Rejects a document where `rejects` of a Page holds. The cost is that of its counts, a byte and a word of text."""

    name: str
    rejects: Callable[[Page], np.ndarray]
    byte_cost: int = 0
    word_cost: int = 0


#: The two rules every document must pass.
BASE_RULES = (
    Rule("few_words", lambda p: p.n_words < 50),
    Rule("repeated_windows", lambda p: 100 * p.n_repeat_words > 50 * p.n_words, 2, 30),
)
#: Further rules, for languages that set spaces between words.
MORE_RULES = (
    Rule("symbols", lambda p: 4 * p.n_symbols > p.n_words, 2),
    Rule("capitals", lambda p: 2 * p.n_upper > p.n_letters, 4),
    Rule("repeated_lines", lambda p: 100 * p.lines[1] > 30 * p.lines[0], 3, 1),
    Rule("short_words", lambda p: p.word_chars < 2 * p.n_words, 2, 3),
    Rule("long_words", lambda p: p.word_chars > 20 * p.n_words, 2, 3),
)
RULES = BASE_RULES + MORE_RULES
#: The rules of the corpus pipeline: repeated lines are judged by their share of the text, so that a short line that comes
#: twice in a text of few lines is no reason. The query keeps the share of lines that its SQL has.
STAGE_RULES = tuple(Rule("repeated_text", lambda p: 100 * p.line_bytes[1] > 30 * p.line_bytes[0], 3, 1) if r.name == "repeated_lines" else r for r in RULES)


def _trial(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, "text"):
            page = Page(Words(cut.column("text")))
            cost = [r.byte_cost * len(page.words.buf) + r.word_cost * len(page.words) + cut.num_rows for r in rules]
            hits = [int(r.rejects(page).sum()) for r in rules]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(cost, pa.int64()), pa.array(hits, pa.int64())], ["rule", "cost", "hits"])

    return run


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample: float = SAMPLE, least: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by estimated rejections per cost, best first, of equal ones in the order given; as given where the
    sample is empty. The sample is a part of all documents, `least` at least. The driver gets one row per rule."""
    share = min(1.0, max(sample, least / max(docs.count(), 1)))
    trial = docs.select(F.col(text).alias("text")).sample(share, seed=11).mapInArrow(_trial(rules), "rule int, cost long, hits long")
    stats = {r["rule"]: r["hits"] / r["cost"] for r in trial.groupBy("rule").agg(F.sum("hits").alias("hits"), F.sum("cost").alias("cost")).collect()}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-stats.get(k, 0.0), k)))


def cascade_verdicts(page: Page, cascade: tuple[Rule, ...]) -> np.ndarray:
    """Per document the place in the cascade of the rule that rejects it, or -1. A rule is asked about what is left."""
    verdict, alive = np.full(len(page.words.counts), -1), np.arange(len(page.words.counts))
    for k, r in enumerate(cascade):
        bad = r.rejects(page)
        if bad.any():
            verdict[alive[bad]] = k
            page, alive = page.only(~bad), alive[~bad]
        if not len(alive):
            break
    return verdict


def _judge(cascade: tuple[Rule, ...], counts: bool):
    names = np.array([*(r.name for r in cascade), None], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, "text"):
            p = Page(Words(cut.column("text")))
            more: list[pa.Array] = []
            if counts:  # asked for of all documents; what else the rules need is counted as they go
                failed = np.zeros(cut.num_rows, bool)
                for r in BASE_RULES:
                    failed |= r.rejects(p)
                more = [pa.array(np.asarray(x, np.int64)) for x in (p.n_words, p.word_chars, p.n_symbols, p.lines[1], p.n_repeat_words)] + [pa.array(failed)]
            reason = pa.array(names[cascade_verdicts(p, cascade)], pa.string())
            yield pa.RecordBatch.from_arrays([cut.column("keys"), reason, *more], ["keys", "rejected_by"] + ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"] * counts)

    return run


def judge(docs: DataFrame, keys: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES, counts: bool = False) -> DataFrame:
    """keys of each document and rejected_by: the rule that rejected it in the cascade's order, null if kept; with
    `counts`, also the counts and base_failed."""
    cascade = plan_cascade(docs, rules, text)
    rows = docs.select(F.struct(*keys).alias("keys"), F.col(text).alias("text"))
    more = ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean" if counts else ""
    return beside_keys(rows, keys, _judge(cascade, counts), f"rejected_by string{more}")


def drop_rejected(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of docs that pass all rules, all columns as they are, in one pass."""
    cascade = plan_cascade(docs, rules, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, text):
            yield cut.filter(pa.array(cascade_verdicts(Page(Words(cut.column(text))), cascade) < 0))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = judge(docs, ["doc_id"], counts=True)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"))


SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
tri as (select doc_id, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) as g
        from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
hit as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from tri) where n > 1),
rep as (select doc_id, count(distinct i + k) as n from hit, (select unnest([0, 1, 2]) as k) group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) as up, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as let
      from w left join rep using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 4 * n_symbols > n_words or 2 * up > let or 100 * n_dup_lines > 30 * n_lines
            or word_chars < 2 * n_words or word_chars > 20 * n_words) as kept
from f
"""

QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES = {"op5_quality_rules": SQL}
