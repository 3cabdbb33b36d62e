"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import table
from tidemark.llm.tokens import mix

#: verdict and rule (host, path) of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Lengths of the character n-grams, buckets, penalty, gradient steps and their size.
GRAMS, BUCKETS, DECAY, STEPS, RATE = (3, 4, 5), 1 << 14, 1e-5, 3000, 8.0

#: Words for what a text corpus does not want, and for what it does: general vocabulary, not names of sites.
UNWANTED = (
    "casino poker slots betting bets jackpot lottery roulette blackjack gambling wager bingo "
    "viagra cialis pills pharmacy meds steroids slimming supplement botox "
    "porn xxx adult sex nude escort cams hentai erotic webcam hookup milf "
    "payday loans loan credit forex crypto binary mortgage debt "
    "replica counterfeit knockoff diploma essaywriter hacks warez torrent keygen cracked "
    "spam popads adserver ads tracker track clicks doubleclick linkfarm backlinks phishing malware giveaway prizes winner"
).split()
ORDINARY = (
    "news daily times journal post gazette library school college university museum gallery theatre music history science nature weather "
    "garden kitchen recipes cooking travel hiking cycling football athletics health clinic hospital dental family kids parents teachers "
    "city town county council parish village river mountain island northern southern western eastern harbour station bridge "
    "books writers poetry reading language grammar dictionary translation maths physics chemistry biology geology astronomy "
    "software linux python database developer engineering robotics hardware electronics photo camera film cinema radio "
    "law court justice police fire rescue charity trust foundation institute society club forum blog wiki docs archive "
    "farm forest bakery coffee wine tea craft knitting pottery wood paper print design fashion furniture house home heating"
).split()
#: What may stand beside a word in a name, in both classes.
BESIDE = ("the", "my", "our", "best", "top", "new", "live", "online", "now", "today", "shop", "world", "club", "central", "direct", "24")
#: Names made from each word, and invented ordinary names: what is unknown is more likely wanted.
NAMES, INVENTED = 6, 400
#: One host in so many is left for the error.
HELD_OUT = 5


def labelled() -> list[tuple[str, str, int]]:
    """(host, path, blocked): each word alone and beside others, under common domains; prefixes and paths go round alike in both classes.

    The table is small and fixed, made by rule from the three lists and from
    syllables, and knows no name of the judged tables.
    """
    tops = ("com", "org", "net", "info", "co.uk", "de", "fr", "io")
    out = []
    begin, middle, end = "b br c ch d dr f g gr h j k kl l m n p pl r s st t tr v w z".split(), "a e i o u ai ea ou".split(), "b d ck l ll m n nd r rt s st t x".split()
    invented = [begin[i * 7 % 26] + middle[i * 5 % 8] + begin[i * 11 % 25] + middle[i * 3 % 7] + end[i * 13 % 14] for i in range(INVENTED)]
    for blocked, names, n in ((1, UNWANTED, NAMES), (0, ORDINARY, NAMES), (0, invented, 1)):
        for i, word in enumerate(names):
            for j in range(n):
                k = 7 * i + 5 * j
                beside = BESIDE[k % len(BESIDE)]
                name = (word, f"{word}-{beside}", f"{beside}-{word}", f"{word}{beside}", f"{beside}{word}", f"{word}-{names[(i * 3 + 11) % len(names)]}")[j % 6]
                host = f"{('', 'www.', 'm.', 'blog.')[(k // 2) % 4]}{name}.{tops[k % len(tops)]}"
                out.append((host, ("/", "/en/120", "/de/77/", "/fr/article.html", "/index.php?id=4", "/2020/05/a")[k % 6], blocked))
    return out


def error(rows: list[tuple[str, str, int]] | None = None) -> dict[str, float]:
    """Shares of unwanted hosts caught and of ordinary ones allowed among whole hosts that training did not see."""
    rows = labelled() if rows is None else rows
    hosts = sorted({h for h, _, _ in rows})
    out = set(hosts[::HELD_OUT])
    w = train([r for r in rows if r[0] not in out])
    said = [(b, _vector(h, p) @ w[:-1] + w[-1] >= 0) for h, p, b in rows if h in out]
    return {
        "caught": sum(s for b, s in said if b) / max(1, sum(b for b, _ in said)),
        "allowed": sum(not s for b, s in said if not b) / max(1, sum(not b for b, _ in said)),
    }


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does. A rule holds for its host and all subdomains."""
    verdict = rule = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.index("/") if "/" in text else len(text)
        name, start = text[:at], text[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def buckets(host: str, path: str) -> np.ndarray:
    """Buckets of the n-grams of host and path, each with marks at its ends; repeats stay."""
    out = [np.zeros(0, np.int64)]
    for kind, text in enumerate((host, path)):
        code = np.frombuffer(f"^{text}$".encode("utf-32-le"), np.uint32).astype(np.uint64)
        for n in GRAMS:
            if len(code) >= n:
                h = np.full(len(code) - n + 1, 10 * n + kind, np.uint64)
                for k in range(n):
                    h = h * np.uint64(1000003) + code[k : len(code) - n + 1 + k]
                out.append((mix(h) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(out)


def _vector(host: str, path: str) -> np.ndarray:
    x = np.bincount(buckets(host, path), minlength=BUCKETS).astype(float)
    return x / max(1.0, np.sqrt((x * x).sum()))


def train(rows: list[tuple[str, str, int]] | None = None, steps: int = STEPS) -> np.ndarray:
    """Weights and, last, the intercept; from a small table of (host, path, blocked) rows. An empty one gives zeros.

    Gradient steps from zero keep the weights a sum of the rows, so each step
    works on the rows' products (as many squared) and not on all buckets.
    """
    rows = labelled() if rows is None else rows
    if not rows:
        return np.zeros(BUCKETS + 1)
    x = np.ones((len(rows), BUCKETS + 1), np.float32)
    for k, (h, p, _) in enumerate(rows):
        x[k, :-1] = _vector(h, p)
    y = np.array([float(b) for _, _, b in rows])
    products, of_row = (x @ x.T).astype(np.float64), np.zeros(len(rows))
    for _ in range(steps):
        of_row += RATE * ((y - 1 / (1 + np.exp(-products @ of_row))) / len(y) - DECAY * of_row)
    return (x.T @ of_row).astype(np.float64)


def judge(pages: DataFrame, weights: np.ndarray, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block per row of ``pages`` (page_id, url).

    The rule's verdict or, without one, block if the model gives it 0.5 or
    more. Null urls and those without :// have empty host and path and are
    judged by the model as such.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for batch in batches:
            p = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                at, n = np.unique(buckets(host, path), return_counts=True)
                p.append(1 / (1 + np.exp(-(n @ w[at] / max(1.0, np.sqrt((n * n).sum())) + w[-1]))))
            yield batch.append_column("p_block", pa.array(p, pa.float64()))

    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    kind = pages.schema["page_id"].dataType.simpleString()
    scored = parts.mapInArrow(run, f"page_id {kind}, host string, path string, p_block double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return judge(table(spark, sf_dir, "pages"), train())
