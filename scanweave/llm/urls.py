"""URL filters (operator 7): host and path rules, and behind them a logistic regression on hashed character n-grams.

The labelled urls are made by a rule from short lists of words by subject: one word or two of a subject as the host,
under the same prefixes, endings and paths for both labels, so that only words tell them apart; and paths of one word
to block on hosts to allow. The model is fitted on them in numpy, once per call, from fixed starts, so calls agree. Host
and path n-grams are hashed apart; a host is scored as a whole with its ends marked. It knows what its words look like
and no more: hosts to block from a subject that no list has are mostly allowed.

Edge cases: a null url, or one without `://`, has an empty host and path, fits no rule and has no features: the
intercept decides (allow); an empty table gives no rows; repeated rows are judged alike; long urls are scored whole;
other columns are ignored, and a result whose name a key has gets an underscore behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import beside_keys, table
from .words import U, mix, running, slices, spans

# Words of urls to block and to allow, a subject a line.
BLOCKED = """
casino poker roulette blackjack jackpot slots betting bets bookmaker gambling lottery wager
adult porn xxx sex nude escort webcam fetish erotic hentai
pills viagra cialis pharmacy meds tramadol steroids slimming
loans payday cash credit lender debt refinance
ads adserver banner popunder tracker tracking click affiliate impression
spam linkfarm backlinks followers bulkmail doorway scraper
warez crack keygen torrent serial nulled pirate
giveaway winner prize doubler replica scam phishing clickbait
"""
ALLOWED = """
news journal gazette herald tribune chronicle magazine report times
school college university academy library campus lecture student
museum gallery orchestra opera cinema festival poetry novel
garden kitchen recipe baking wine coffee farm market
hospital clinic nursing dental surgery wellness nutrition
city council parliament ministry embassy court police
football tennis cycling rowing hockey marathon stadium
physics biology chemistry astronomy geology math climate
software linux python database compiler forum support manual
travel hotel railway airport harbour island mountain river
bank insurance accounting audit law notary
bird horse fish forest flower insect whale
shop books shoes furniture camera bicycle tools
blog diary photo craft knitting music radio guitar
bridge tower castle village station theatre weather mother
"""
#: What hosts and paths of both labels have around the words.
PREFIXES, ENDINGS = ("", "www.", "m.", "blog."), ("example.com", "example.org", "example.net")
PATHS = ("/", "/index.html", "/item/17", "/2024/05/post.html", "/a/b/", "/page/3", "/about")

FEATURES, SIZES = 1 << 14, (3, 4, 5)
BASE = {3: 0x9E3779B97F4A7C15, 4: 0xC2B2AE3D27D4EB4F, 5: 0xD1342543DE82EF95}


def strings_features(texts: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each character n-gram (over bytes) of `^text$`; null: none."""
    rows = [("^" + t + "$").encode() if t else b"" for t in texts.to_pylist()]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    buf = np.frombuffer(b"".join(rows), np.uint8)
    out_row, out_f = [], []
    for n in SIZES:
        sums = running(buf.astype(U) + U(1), BASE[n])
        per = np.maximum(np.diff(ends) - n + 1, 0)
        row = np.repeat(np.arange(len(rows)), per)
        at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + ends[:-1][row]
        out_row.append(row)
        out_f.append((mix(spans(sums, at, at + n, BASE[n]) + U(salt * 64 + n)) % U(FEATURES)).astype(np.int64))
    return np.concatenate(out_row), np.concatenate(out_f)


def url_features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value): n-grams of host and path; values of a row have length 1."""
    a, b = strings_features(hosts, 1), strings_features(paths, 2)
    row, f = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    norm = np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1))
    return row, f, 1 / norm[row]


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    intercept: float

    def score(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """Probability that the url is one to block."""
        row, f, v = url_features(hosts, paths)
        return 1 / (1 + np.exp(-(np.bincount(row, v * self.weights[f], len(hosts)) + self.intercept)))


def labelled(words: str) -> list[tuple[str, str]]:
    """(host, path) of urls made of words, a subject a line: each word alone, and joined to the next three of its subject
    with a hyphen or without."""
    names = []
    for line in words.strip().splitlines():
        w = line.split()
        for k, a in enumerate(w):
            names += [a, *(a + "-" * (j % 2) + w[(k + j) % len(w)] for j in (1, 2, 3))]
    # steps without a common factor, so that every name meets different surroundings
    return [(PREFIXES[k % 4] + n + "." + ENDINGS[k % 3], PATHS[k % 7]) for k, n in enumerate(names)]


def train(blocked: str = BLOCKED, allowed: str = ALLOWED, rounds: int = 400, rate: float = 8.0, penalty: float = 2e-4, prior: float = 0.3) -> UrlModel:
    """Full-batch gradient descent with an L2 penalty. The labels weigh as a prior share of urls to block has it, the
    table's own share says nothing of the web's; the intercept is that of the prior, so a url of unknown words is allowed."""
    yes, no = labelled(blocked), labelled(allowed)
    bad, good = blocked.split(), allowed.split()
    yes += [(no[7 * k % len(no)][0], f"/{w}/{good[5 * k % len(good)]}") for k, w in enumerate(bad)]
    no += [(no[11 * k % len(no)][0], f"/{a}/{good[3 * k % len(good)]}") for k, a in enumerate(good)]
    row, f, v = url_features(*(pa.array([u[k] for u in (*yes, *no)]) for k in (0, 1)))
    y = np.array([1.0] * len(yes) + [0.0] * len(no))
    share = np.where(y > 0, prior / len(yes), (1 - prior) / len(no))
    w, b = np.zeros(FEATURES), float(np.log(prior / (1 - prior)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, v * w[f], len(y)) + b)))
        w -= rate * (np.bincount(f, v * ((p - y) * share)[row], FEATURES) + penalty * w)
    return UrlModel(w, b)


#: Fixed values: (host, path prefix, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), F.lit("")), CAPITALS, CAPITALS.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(pages: DataFrame, keys: list[str], url: str = "url", rules: tuple = RULES) -> DataFrame:
    """`keys` (a struct), host, path, rule (host and path prefix of the longest that fits, else null), verdict (its own)."""
    host, path = F.col("host"), F.col("path")
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # later ones, being longer, win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    rows = pages.select(F.struct(*keys).alias("keys"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return rows.select("*", rule.alias("rule"), verdict.alias("verdict"))


def judge_urls(pages: DataFrame, keys: list[str], url: str = "url", rules: tuple = RULES, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """keys, host, path, rule, verdict, score. The score is made for the urls that no rule decides only; it is null for
    the others."""
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, "path", 1 << 20):
            ruled = cut.column("verdict").to_pylist()
            open_ = pa.array([k for k, v in enumerate(ruled) if v is None], pa.int64())
            score = np.full(cut.num_rows, np.nan)
            score[open_.to_numpy()] = model.score(cut.column("host").take(open_), cut.column("path").take(open_))
            verdict = pa.array([v or ("block" if s >= threshold else "allow") for v, s in zip(ruled, score, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*cut.columns[:-1], verdict, pa.array(score, from_pandas=True)], [*cut.schema.names, "score"])

    return beside_keys(with_rules(pages, keys, url, rules), keys, run, "host string, path string, rule string, verdict string, score double")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 7 that SQL can express: host, path and rule, and the rule's verdict."""
    return with_rules(table(spark, sf_dir, "pages"), ["page_id"]).select("keys.page_id", "host", "path", "rule", "verdict")


RULES_SQL = r"""
with after as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
part as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from after),
fit as (select *, case
    when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
    when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
    when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
    when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule from part)
select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' end as verdict from fit
"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), ["page_id"])


QUERIES = {"op7_url_filter": op7_url_filter, "url_rules": url_rules}
ORACLES = {"url_rules": RULES_SQL}
