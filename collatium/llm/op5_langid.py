"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior for each row: the likelihood of its text under byte-trigram models, the
language its markup declares, the suffix of its address, and a prior for its host. Host priors are smoothed in steps:
a host's counts towards its domain's, a domain's towards the whole table's. Counts are grouped aggregates of the
text-only decisions over all rows. One more hypothesis, 'und', stands for text in none of the languages.

The trigram models are fitted on at most TRAIN rows, picked by a hash of the text's id, whose declared language is one
of ``languages``; everything else covers all rows. A null text counts as empty; a row without evidence gets its host's
prior. A text without a letter is 'und'. A null or unknown declaration and a null or empty host say nothing: such a row
neither adds to a prior nor gets one. Repeated rows are judged alike; ties go to the earlier language; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatium.llm.common import cut, giving_back, keyed_join

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
#: Rows that the trigram models are fitted on, buckets of trigrams, trigrams that a text's likelihood counts for at most.
TRAIN, BUCKETS, WEIGHT = 4000, 1 << 14, 60
#: Chance that a declaration or a national suffix is right, prior of 'und', rows that a smoothing step counts for.
DECLARED, SUFFIX, ODD, STRENGTH = 0.9, 0.7, 0.01, 20.0
#: Second-level names below which national registries assign domains, and national address suffixes: fixed values.
SECOND = ("co", "com", "org", "net", "ac", "gov", "edu")
NATIONAL = {"de": "de", "at": "de", "uk": "en", "us": "en", "au": "en", "ie": "en", "es": "es", "mx": "es", "ar": "es", "co": "es", "fr": "fr"}
PIECE = 1 << 20


def trigrams(raw: bytes) -> np.ndarray:
    """The bucket of every byte trigram."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def pieces(text: str | None) -> Iterator[bytes]:
    """Lower-cased UTF-8 with a blank on either side, in pieces that share two bytes, so that long texts need no more memory."""
    raw = b" " + (text or "").lower().encode("utf-8", "replace") + b" "
    for i in range(0, max(1, len(raw) - 2), PIECE):
        yield raw[i : i + PIECE + 2]


@dataclass
class Model:
    languages: tuple[str, ...]
    #: (BUCKETS, languages and 'und'), natural logarithms
    table: np.ndarray

    def likelihoods(self, text: str | None) -> list[float]:
        """Log-likelihoods of a text, scaled down to WEIGHT trigrams where it has more. Without a letter only 'und' is left."""
        total, n = np.zeros(len(self.languages) + 1), 0
        for raw in pieces(text):
            at = trigrams(raw)
            total += self.table[at].sum(0, dtype=np.float64)
            n += len(at)
        if text and not any(map(str.isalpha, text)):
            total[:-1] = -1e6
        return (total * min(1.0, WEIGHT / max(1, n)) if (text or "").strip() else total * 0).tolist()


def fit(docs: DataFrame, key: str, text: str, declared: str, languages: tuple[str, ...] = LANGUAGES, rows: int = TRAIN) -> Model:
    """Trigram models of a bounded sample of declared rows; its counts are summed where the rows are."""
    known = docs.filter(F.col(declared).isin(*languages) & F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(declared).alias("_d"), F.col(text).alias("_t"))
    # the hash of the id decides, so only ids are sorted; the sample's ids are few and are sent to all
    picked = known.select("_k").distinct().orderBy(F.xxhash64("_k"), "_k").limit(rows)
    sample = known.join(F.broadcast(picked), "_k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, value in zip(batch.column("_d").to_pylist(), batch.column("_t"), strict=True):
                for raw in pieces(value.as_py()):
                    sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(raw), minlength=BUCKETS)
        for lang, n in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "n": [n.astype(np.int64)]}, schema=pa.schema([("lang", pa.string()), ("n", pa.list_(pa.int64()))]))

    counts = np.zeros((BUCKETS, len(languages)))
    parts = sample.coalesce(8).mapInArrow(count, "lang string, n array<long>")
    for r in parts.collect():  # at most one array of BUCKETS for each language and task
        counts[:, languages.index(r.lang)] += np.array(r.n)
    smooth = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS))
    return Model(tuple(languages), np.concatenate([smooth, np.full((BUCKETS, 1), -np.log(BUCKETS))], axis=1).astype(np.float32))


def with_likelihoods(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """docs with the column _ll: log-likelihoods under each language and 'und'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.likelihoods(x.as_py()) for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names, "_ll"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], "_ll array<double>"])
    return docs.mapInArrow(giving_back(run), schema)


def _logs(values: list[Column]) -> Column:
    return F.array(*[F.log(v) for v in values])


def domain_of(host: Column) -> Column:
    """The last two labels of a host, or three where the second last is a registry's (a.co.uk)."""
    labels = F.split(host, "\\.")
    deep = (F.size(labels) > 2) & F.element_at(labels, -2).isin(*SECOND) & (F.length(F.element_at(labels, -1)) == 2)
    keep = F.least(F.when(deep, 3).otherwise(2), F.size(labels))
    return F.array_join(F.slice(labels, -keep, keep), ".")


def host_priors(votes: DataFrame, n: int) -> DataFrame:
    """(_host, _prior array<double>, _rows) from votes (_host, _domain, _best int or null): log-probabilities of n languages.

    Counts are partial aggregates, so a host with a third of all rows is no larger than any other.
    """
    tally = [F.sum(F.when(F.col("_best") == i, 1.0).otherwise(0.0)).alias(f"c{i}") for i in range(n)]
    hosts = cut(votes.groupBy("_host", "_domain").agg(*tally, F.count("*").alias("_rows")))
    domains = cut(hosts.groupBy("_domain").agg(*[F.sum(f"c{i}").alias(f"d{i}") for i in range(n)], F.count("*").alias("_hosts")))
    *sums, count = domains.agg(*[F.sum(f"d{i}") for i in range(n)], F.sum("_hosts")).first()
    base = [((x or 0.0) + 1.0) / (sum(x or 0.0 for x in sums) + n) for x in sums]
    over = lambda c: sum((F.col(f"{c}{i}") for i in range(1, n)), F.col(f"{c}0"))
    domains = domains.select("_domain", "_hosts", *[((F.col(f"d{i}") + STRENGTH * base[i]) / (over("d") + STRENGTH)).alias(f"p{i}") for i in range(n)])
    known = keyed_join(hosts, domains, ["_domain"], "_hosts", count or 0)
    return known.select("_host", "_rows", _logs([(F.col(f"c{i}") + STRENGTH * F.col(f"p{i}")) / (over("c") + STRENGTH) for i in range(n)]).alias("_prior"))


def identify(docs: DataFrame, model: Model, text: str, declared: Column, host: Column, hold=None) -> DataFrame:
    """docs with language, confidence and accepted.

    declared: a column with the code of the declared language; host: one with the host (or, where rows have none, the
    source). hold: a function applied to the rows once their likelihoods are known, to keep them (cut), else they are
    computed again for the second use; it may drop columns. accepted: the most probable hypothesis is a language, not 'und'.
    """
    n = len(model.languages)
    rows = docs.withColumns({"_declared": F.substring(F.lower(declared), 1, 2), "_host": F.nullif(F.lower(host), F.lit(""))})
    rows = with_likelihoods(rows, model, text)
    rows = hold(rows) if hold else rows
    names = [c for c in rows.columns if c in docs.columns]
    best = F.when(F.exists("_ll", lambda x: x != 0), F.array_position("_ll", F.array_max("_ll")) - 1).cast("int")
    votes = rows.filter("_host is not null").select("_host", domain_of(F.col("_host")).alias("_domain"), best.alias("_best"))
    priors = cut(host_priors(votes, n))
    total = priors.agg(F.sum("_rows")).first()[0] or 0
    even = F.lit(float(-np.log(n)))
    suffix = F.element_at(F.create_map(*[F.lit(x) for pair in NATIONAL.items() for x in pair]), F.element_at(F.split("_host", "\\."), -1))
    said = lambda col, lang, right: F.when(col == lang, float(np.log(right))).when(col.isin(*model.languages), float(np.log((1 - right) / max(1, n - 1)))).otherwise(0.0)
    # rows without a host share no key: they stay where they are
    rows = keyed_join(rows.filter("_host is not null"), priors, ["_host"], "_rows", total).unionByName(rows.filter("_host is null"), allowMissingColumns=True)
    scores = [F.col("_ll")[i] + said(F.col("_declared"), lang, DECLARED) + said(suffix, lang, SUFFIX) + F.coalesce(F.col("_prior")[i], even) for i, lang in enumerate(model.languages)]
    scores.append(F.col("_ll")[n] + F.lit(float(np.log(ODD))))
    rows = rows.withColumn("_score", F.array(*scores)).withColumn("_top", F.array_max("_score"))
    mass = F.aggregate("_score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    language = F.element_at(F.array(*[F.lit(x) for x in (*model.languages, UNKNOWN)]), F.array_position("_score", F.col("_top")).cast("int"))
    rows = rows.withColumns({"language": language, "confidence": F.round(1 / mass, 6)}).withColumn("accepted", F.col("language") != UNKNOWN)
    return rows.select(*[F.col(f"`{c}`") for c in names if c not in ("language", "confidence", "accepted")], "language", "confidence", "accepted")


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host) of raw pages: text without scripts, styles and tags."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(
        "page_id",
        F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ").alias("text"),
        F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1)).alias("declared"),
        F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).alias("host"),
    )
