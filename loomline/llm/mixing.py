"""Problem 7: records of several sources combined so that each source makes up its target share of the tokens.

Method: soft-membership mixing. A classifier fitted on the table's own source labels predicts, for records without
one, the posterior of each source; a record with a known source belongs to it alone. Distributed projected-gradient
least squares then fits a nonnegative rate for each record, at most its allowed number of repeats, so that the
expected tokens of each source meet its target. Rates become whole numbers of repeats by carrying the error over.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.tokens import VOCABULARY, encoder, sample_texts, shipped

#: Bounds of the classifier: labelled records looked at and bytes of their texts, hash buckets of its words.
MAX_LABELLED, MAX_BYTES = 3000, 32 << 20
BUCKETS = 1 << 14
#: Posteriors are kept as multiples of this, so that records of equal ones can be added up before the fit.
GRAIN = 1 / 200
MAX_STEPS = 60
TOLERANCE = 1e-4
#: Where the targets aren't met this closely in MAX_STEPS steps, a smaller selection is fitted.
LOOSE, SHRINK, MAX_SHRINKS = 5e-3, 0.93, 12
#: Rates are rounded within groups of about so many records.
GROUP_RECORDS = 5000


def source_key(column: str | Column) -> Column:
    """A source's name in one spelling: letters' case, blanks and underscores don't matter; blank names are null."""
    c = F.lower(F.trim(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"[\s_ ]+", " ")))
    return F.when(c != "", c)


def _bag(text: str) -> np.ndarray:
    words = re.findall(r"\w+", text.lower())
    return np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.int64, len(words))


@dataclass
class Classifier:
    """Multinomial naive Bayes with a temperature learned on held-out records."""

    classes: list[str]
    log_prior: np.ndarray
    log_rate: np.ndarray  # (BUCKETS, classes)
    temperature: float = 1.0

    def log_likelihood(self, texts: list[str]) -> np.ndarray:
        return np.stack([self.log_rate[_bag(t)].sum(axis=0) for t in texts]) if texts else np.zeros((0, len(self.classes)))

    def posterior(self, texts: list[str]) -> np.ndarray:
        log = self.log_prior + self.log_likelihood(texts) / self.temperature
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], classes: list[str]) -> Classifier:
    """rows: (text, class). The temperature makes held-out posteriors as probable as they can be, so where the text
    says nothing about the source, the posteriors stay near the shares of the sources."""
    k = len(classes)
    at = {c: i for i, c in enumerate(classes)}

    def fit(part: list[tuple[str, str]]) -> Classifier:
        counts, docs = np.full((BUCKETS, k), 0.05), np.ones(k)
        for text, c in part:
            np.add.at(counts[:, at[c]], _bag(text), 1)
            docs[at[c]] += 1
        return Classifier(classes, np.log(docs / docs.sum()), np.log(counts / counts.sum(axis=0)))

    half = fit(rows[::2])
    held = rows[1::2]
    if held:
        score, y = half.log_likelihood([t for t, _ in held]), np.array([at[c] for _, c in held])

        def loss(temperature: float) -> float:
            log = half.log_prior + score / temperature
            log -= log.max(axis=1, keepdims=True)
            return float((np.log(np.exp(log).sum(axis=1)) - log[np.arange(len(y)), y]).mean())

        temperature = min((1.0, 2.0, 5.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 10000.0), key=loss)
    else:
        temperature = 1.0
    whole = fit(rows)
    whole.temperature = temperature
    return whole


def _targets(mix_targets: DataFrame) -> pd.DataFrame:
    """One row per source (a small, given table): share and repeats; rows without a source or share count as none."""
    t = mix_targets.select(F.trim("source").alias("source"), source_key("source").alias("key"), "target_share", "max_repeats").where("key is not null")
    t = t.groupBy("key").agg(F.min("source").alias("source"), F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).toPandas()
    t["share"] = t["share"].fillna(0.0).clip(lower=0.0)
    t["repeats"] = t["repeats"].fillna(0).clip(lower=0).astype(int)
    return t.sort_values("key").reset_index(drop=True)


def _grained(p: np.ndarray) -> np.ndarray:
    """Posteriors in whole grains that add up to one: what rounding down leaves over goes to the largest remainders."""
    whole = np.floor(p / GRAIN + 1e-9)
    order = np.argsort(-(p / GRAIN - whole), axis=1, kind="stable")
    left = np.round(1 / GRAIN - whole.sum(axis=1)).astype(int)
    np.put_along_axis(whole, order, np.take_along_axis(whole, order, axis=1) + (np.arange(p.shape[1]) < left[:, None]), axis=1)
    return whole * GRAIN


def memberships(documents: DataFrame, keys: list[str], path: str = VOCABULARY, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, key, tokens, p) of the records that may take part: p is the probability of each of ``keys``, one of them
    for a record with a known source, the classifier's posterior for one without (what is missing to one is the
    probability of the sources without target). Records of other sources give no row, and those without source
    none where no record has one to learn from."""
    from loomline.plans.lineage import spread_small

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", source_key("source").alias("key")).where("doc_id is not null")
    picked = sample_texts(rows.where("key is not null"), "doc_id", max_labelled, max_bytes)
    classes = [*keys, "\x00other"]
    model = train([(r.text, r.key if r.key in keys else classes[-1]) for r in sorted(picked, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))], classes) if picked else None
    at, held = {k: i for i, k in enumerate(keys)}, shipped(documents.sparkSession, path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, held).encode_ordinary
        for frame in frames:
            p = np.zeros((len(frame), len(classes)))
            code = frame["key"].map(at).fillna(-1).to_numpy().astype(int)
            p[np.flatnonzero(code >= 0), code[code >= 0]] = 1
            soft = np.flatnonzero(code < 0)
            if len(soft):
                p[soft] = _grained(model.posterior([t or "" for t in frame["text"].iloc[soft]]))
            sizes = np.fromiter((len(encode(t)) if t else 0 for t in frame["text"]), np.int64, len(frame))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "key": frame["key"], "tokens": sizes, "p": pd.Series(list(p[:, :-1]), dtype=object, index=frame.index)})

    wanted = F.col("key").isin(keys) if keys else F.lit(False)
    usable = spread_small(rows).where(wanted | F.col("key").isNull() if model else wanted)
    return usable.mapInPandas(run, "doc_id long, key string, tokens long, p array<double>")


def repeats_of(p: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """How often each record may be used: its source's repeats; for one without, the whole part of the mean over the
    sources that it may be of, at least once."""
    share = p.sum(axis=1)
    mean = p @ repeats / np.maximum(share, 1e-12)
    return np.where(p @ repeats > 0, np.maximum(np.floor(mean + 1e-9), 1), 0.0)


def rates(p: np.ndarray, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rate of each record after the given projected-gradient steps. A record's rate depends on nothing but its
    memberships, its cap and the steps, so no state has to be kept between the passes over the records."""
    r = np.zeros(len(p))
    for step in steps:
        r = np.clip(r - p @ step, 0.0, caps)
    return r


def fit_rates(members: DataFrame, share: np.ndarray, repeats: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(steps, target tokens by source, reached expected tokens by source).

    Sources with a share and labelled records are fitted; others can't be steered, and what posteriors give to them
    counts for none. The size of the selection is the largest at which the labelled records alone could meet every
    share, so that targets can be met whatever the records without source add. Should a step's limits keep a target from
    being met, the selection is made smaller; targets that even then aren't met are warned of, and the report of ``shares``
    shows by how much. Records of equal memberships are added up first; each step is one distributed pass over those.
    """
    from loomline.plans.lineage import cut

    k = len(share)
    rows = members.where("tokens > 0")
    grouped = cut(rows.groupBy("p", F.col("key").isNotNull().alias("known")).agg(F.sum("tokens").cast("double").alias("tokens")))

    def expected(steps: list[np.ndarray] | None, known_only: bool = False) -> np.ndarray:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(k)
            for frame in frames:
                if len(frame):
                    p = np.stack(frame["p"].to_list())
                    r = rates(p, repeats_of(p, repeats), steps) if steps is not None else np.ones(len(p))
                    total += (p * (r * frame["tokens"].to_numpy())[:, None]).sum(axis=0)
            yield pd.DataFrame({"s": range(k), "t": total})

        source = grouped.where("known") if known_only else grouped
        got = source.select("p", "tokens").mapInPandas(run, "s int, t double").groupBy("s").agg(F.sum("t").alias("t")).toPandas()
        out = np.zeros(k)
        out[got["s"].to_numpy()] = got["t"].to_numpy()
        return out

    mass, labelled = expected(None), expected(None, known_only=True)
    able = (share > 0) & (labelled > 0) & (repeats > 0)
    if not able.any():
        return [], np.zeros(k), np.zeros(k)
    wanted = np.where(able, share, 0.0) / share[able].sum()
    size = float((repeats[able] * labelled[able] / wanted[able]).min())
    for _ in range(MAX_SHRINKS):
        steps, target, reached = [], size * wanted, np.zeros(k)
        for _ in range(MAX_STEPS):
            residual = np.where(able, reached - target, 0.0)
            if np.abs(residual).max() <= TOLERANCE * size:
                return steps, target, reached
            # Preconditioned by each source's mass: records of known sources meet the targets at once, the others' shares
            # make for a few steps more.
            steps.append(np.where(mass > 0, residual / np.maximum(mass, 1.0), 0.0))
            reached = expected(steps)
        if np.abs(np.where(able, reached - target, 0.0)).max() <= LOOSE * size:
            break
        size *= SHRINK
    else:
        warnings.warn(f"the nearest mixture misses a target by {np.abs(np.where(able, reached - target, 0.0)).max() / target.sum():.4f} of its size", stacklevel=2)
    return steps, target, reached


SELECTED = "doc_id long, key string, tokens long, p array<double>, rate double, repeats int"


def _round(steps: list[np.ndarray], repeats: np.ndarray):
    """Whole repeats of one group: large records first, each rounded so that the carried error stays least."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        p = np.stack(frame["p"].to_list())
        caps = repeats_of(p, repeats)
        r = rates(p, caps, steps)
        whole, most = np.floor(r + 1e-9), np.floor(caps + 1e-9)
        out, error = np.zeros(len(frame), np.int64), 0.0
        for i, t in enumerate(frame["tokens"].to_numpy(np.float64)):
            error += (r[i] - whole[i]) * t
            up = whole[i] + 1 <= most[i] and r[i] > whole[i] + 1e-9 and error >= t / 2
            out[i] = int(whole[i]) + up
            error -= up * t
        for i, t in enumerate(frame["tokens"].to_numpy(np.float64)):  # where one large record couldn't be met halfway, others make up for it
            more = int(np.clip(np.floor(error / t + 0.5) if error >= t / 2 else 0, 0, most[i] - out[i]))
            less = int(np.clip(np.floor(-error / t + 0.5) if -error >= t / 2 else 0, 0, out[i]))
            out[i] += more - less
            error -= (more - less) * t
        return pd.DataFrame({"doc_id": frame["doc_id"], "key": frame["key"], "tokens": frame["tokens"], "p": frame["p"], "rate": r, "repeats": out.astype(np.int32)})

    return run


def mix(documents: DataFrame, mix_targets: DataFrame, path: str = VOCABULARY) -> tuple[DataFrame, pd.DataFrame]:
    """(selection, targets): selection (doc_id, key, tokens, rate, repeats) of the records used at least once."""
    from loomline.plans.lineage import cut

    targets = _targets(mix_targets)
    keys, share, repeats = targets["key"].tolist(), targets["share"].to_numpy(float), targets["repeats"].to_numpy(float)
    members = cut(memberships(documents, keys, path))
    steps, _, _ = fit_rates(members, share, repeats)
    if not steps:
        return documents.sparkSession.createDataFrame([], SELECTED), targets
    groups = max(1, -(-members.count() // GROUP_RECORDS))
    # A group holds one source's (or the sourceless) records of one hash value: about GROUP_RECORDS of them at most.
    grouped = members.where("tokens > 0").withColumn("own", F.coalesce("key", F.lit(""))).withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    return grouped.groupBy("own", "g").applyInPandas(_round(steps, repeats), SELECTED).where("repeats > 0"), targets


def selection(documents: DataFrame, mix_targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, repeats): the records of the mixture and how often each is used.

    A record without an id or tokens, or whose source has no target, a target of 0 or no repeats, isn't used; one without a
    source takes part by the posterior of its text and counts towards the sources in that proportion. Where a
    targeted source has no records, the others keep their ratios. Empty tables give no rows.
    """
    chosen, targets = mix(documents, mix_targets, path)
    names = documents.sparkSession.createDataFrame([(t.key, t.source) for t in targets.itertuples()], "key string, source string")
    return chosen.join(F.broadcast(names), "key", "left").select("doc_id", "source", "tokens", "repeats")


def shares(documents: DataFrame, mix_targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(source, target_share, reached_share, tokens, records, labelled_tokens): the shares reached, for every source with
    a target. A record used without a known source counts by its posterior, as ``records`` too; ``labelled_tokens``
    are those of the records with the source as their label. The row with null source holds what posteriors give to
    sources without target."""
    chosen, targets = mix(documents, mix_targets, path)
    spark, k = documents.sparkSession, len(targets)
    table = spark.createDataFrame([(i, t.source, float(t.share)) for i, t in enumerate(targets.itertuples())], "s int, source string, target_share double")
    other = F.greatest(F.lit(1.0) - F.aggregate("p", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    each = chosen.select(F.col("key").isNotNull().alias("known"), (F.col("tokens") * F.col("repeats")).alias("size"), F.posexplode(F.concat("p", F.array(other))).alias("s", "m")).where("m > 0")
    own = F.when(F.col("known"), F.col("size")).otherwise(F.lit(0))
    by = each.groupBy("s").agg(F.sum(F.col("m") * F.col("size")).alias("tokens"), F.sum("m").alias("records"), F.sum(own).alias("labelled_tokens"))
    total = by.agg(F.sum("tokens")).first()[0] or 0.0
    joined = by.where((F.col("s") < k) | (F.col("tokens") > 1e-6)).join(table, "s", "full_outer")
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c)
    return joined.select("source", "target_share", (F.coalesce("tokens", F.lit(0.0)) / F.lit(max(total, 1.0))).alias("reached_share"), zero("tokens", "double"), zero("records", "double"), zero("labelled_tokens", "long"))
