"""Problem 5: the language of each record and of each of its passages, with a confidence.

Method: a linear-chain conditional random field over the words. Each word's score for a label (nine languages and
'no language', for names and signs) is the sum of learned weights of its affixes, n-grams, whole form and lexicon
entries; transitions are learned too. A word without language keeps the language around it in its state, so that
names don't cut the context. Words get their state from the posterior marginals of the forward-backward
recursion. Training is weakly supervised by the stored labels: a word may have the record's language, or none where
it is written like a name, and the likelihood of all allowed labellings is maximised on a bounded sample.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "pt", "sv", "ru")
NONE = len(LANGUAGES)
STATES = NONE + 1
#: States of the chain: the languages, and no language within the context of each.
CHAIN = 2 * NONE
# Other ways to name a language.
NAMES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français", "es": "es spa spanish español", "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands", "pt": "pt por portuguese português", "sv": "sv swe swedish svenska", "ru": "ru rus russian русский",
}
# Frequent function words that only one of the nine languages has.
LEXICON = {
    "en": "the and of with this that for have from their which would could should they",
    "de": "der das und nicht ist mit ein eine auf für dem sich auch werden zum wird schon",
    "fr": "les dans pour qui une avec au ce cette nous vous aux après être encore",
    "es": "el los las y muy pero su hay cuando también hasta donde según",
    "it": "che gli della non è sono anche questo nel dei più ancora degli perché",
    "nl": "het een van niet zijn voor maar ook naar bij wordt werd nog volgens",
    "pt": "os não uma são você ele foi pela ao isso também às depois ainda",
    "sv": "och att det som är på av för inte har ett från till någon efter",
    "ru": "и в не на что он как это по но из у за от так же для",
}
#: Bounds of the training: records looked at, passes over them, hash buckets of the weights.
MAX_TRAINING_RECORDS = 8000
EPOCHS = 45
RATE, FLOOR = 0.3, 1e-4
BUCKETS = 1 << 18
PAD = BUCKETS + STATES
GRAMS = (2, 3, 4)


def label_code(label: str | None) -> str | None:
    """The two-letter code that a stored label names, if it names one of the nine languages."""
    return _CODES.get(re.split(r"[-_]", (label or "").strip().lower())[0])


_CODES = {name: code for code, names in NAMES.items() for name in names.split()}
_LEX = {w: LANGUAGES.index(code) for code, words in LEXICON.items() for w in words.split()}
_ALIKE = str.maketrans("аеѕіјорсухһӏԁοναικρɑɡ", "aesijopcyxhldovaikpag")
_ALIKE_BACK = str.maketrans("aeopcyxABEKMHOPCTX", "аеорсухАВЕКМНОРСТХ")


_CYRILLIC, _LATIN = re.compile("[Ѐ-ӿ]"), re.compile("[a-zà-ÿ]")
RUSSIAN = LANGUAGES.index("ru")


def plain(word: str) -> str:
    """A word without disguise: compatibility forms, unseen characters and stray look-alike letters undone."""
    if word.isascii():
        return word
    word = "".join(c for c in unicodedata.normalize("NFKC", word) if unicodedata.category(c) not in ("Cf", "Mn")).strip().lower()
    if re.search("[a-z]", word) and re.search("[Ѐ-ӿͰ-Ͽɐ-ʯ]", word):
        return word.translate(_ALIKE_BACK if re.search("[бвгджзийклмнптфцчшщъыьэюяё]", word) else _ALIKE)
    return word


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights), one row per word; rows of unequal length are padded. All words should be of similar length."""
    width = max(map(len, words)) + 2
    text = np.array([f"\x02{w}\x03" for w in words], dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    at = np.arange(width)
    index, weight = [], []
    whole = np.full(len(words), 0x811C9DC5, np.uint32)
    for i in range(width):
        whole = np.where(i < length, (whole ^ text[:, i]) * np.uint32(0x01000193), whole)
    index.append(_mix(whole)[:, None].astype(np.int32))
    lex = np.fromiter((BUCKETS + _LEX[w] if w in _LEX else PAD for w in words), np.int32, len(words))
    index.append(lex[:, None])
    weight.append(np.ones((len(words), 2), np.float32))
    grams = np.maximum(1, sum(np.maximum(0, length - n + 1) for n in GRAMS))
    for n in GRAMS:
        if width < n:
            continue
        h = np.full((len(words), width - n + 1), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ text[:, k : width - n + 1 + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(13)
        valid = at[None, : width - n + 1] + n <= length[:, None]
        index.append(np.where(valid, _mix(h).astype(np.int32), PAD))
        weight.append(np.broadcast_to((2 / np.sqrt(grams))[:, None].astype(np.float32), h.shape))
    return np.concatenate(index, axis=1), np.concatenate(weight, axis=1)


def _by_length(words: list[str], cells: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions, indices, weights of the words in blocks of similar length, however long the longest word is."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (len(words[order[end]]) + 2) * 3 * (end - at + 1) <= cells and len(words[order[end]]) <= 2 * len(words[order[at]]) + 8:
            end += 1
        block = order[at:end]
        yield np.array(block), *features([words[i] for i in block])
        at = end


def script_scores(words: list[str]) -> np.ndarray:
    """(words, STATES): a fixed penalty on the languages that aren't written in a word's script."""
    cyrillic = np.array([bool(_CYRILLIC.search(plain(w))) for w in words], bool)
    latin = np.array([bool(_LATIN.search(plain(w))) for w in words], bool) & ~cyrillic
    out = np.zeros((len(words), STATES), np.float32)
    out[np.ix_(cyrillic, [k for k in range(NONE) if k != RUSSIAN])] = -12
    out[latin, RUSSIAN] = -12
    return out


@dataclass
class Model:
    weights: np.ndarray  # (PAD + 1, STATES); the last row is zero
    transitions: np.ndarray  # (CHAIN, CHAIN), log scale
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), STATES), np.float32)
        for where, index, weight in _by_length([plain(w) for w in words]):
            out[where] = np.einsum("vfs,vf->vs", self.weights[index], weight)
        return out + script_scores(words)


def _batches(lengths: np.ndarray, size: int) -> Iterator[np.ndarray]:
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * int(lengths[order[end]]) <= size:
            end += 1
        yield order[at:end]
        at = end


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior marginals (B, T, S), summed pair marginals (S, S), first marginals (S,), log normalisers (B,).

    scores: log emissions (B, T, S), -inf where a state isn't allowed; padded beyond the lengths.
    """
    b, t_max, s = scores.shape
    top = scores.max(axis=2, keepdims=True)
    emit = np.exp(scores - top)
    a = np.exp(transitions)
    alpha, scale = np.zeros_like(emit), np.ones((b, t_max), emit.dtype)
    live = np.arange(t_max)[None, :] < lengths[:, None]
    x = np.exp(start)[None, :] * emit[:, 0]
    for t in range(t_max):
        if t:
            x = (alpha[:, t - 1] @ a) * emit[:, t]
        scale[:, t] = np.maximum(x.sum(axis=1), 1e-30)
        alpha[:, t] = x / scale[:, t, None]
        if t:
            alpha[:, t] = np.where(live[:, t, None], alpha[:, t], alpha[:, t - 1])
    beta = np.ones_like(emit)
    pairs = np.zeros((s, s))
    for t in range(t_max - 2, -1, -1):
        ahead = emit[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
        on = live[:, t + 1, None]
        beta[:, t] = np.where(on, ahead @ a.T, 1)
        pairs += (np.where(on, alpha[:, t], 0).T @ np.where(on, ahead, 0)) * a
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-30)
    gamma *= live[:, :, None]
    log = (np.log(scale) * live).sum(axis=1) + (top[:, :, 0] * live).sum(axis=1)
    return gamma, pairs, gamma[:, 0].sum(axis=0), log


def spread(scores: np.ndarray) -> np.ndarray:
    """Label scores (..., STATES) as scores of the chain's states (..., CHAIN)."""
    return np.concatenate([scores[..., :NONE], np.repeat(scores[..., NONE:], NONE, axis=-1)], axis=-1)


def gather(marginals: np.ndarray) -> np.ndarray:
    """Marginals of the chain's states as marginals of the labels."""
    return np.concatenate([marginals[..., :NONE], marginals[..., NONE:].sum(axis=-1, keepdims=True)], axis=-1)


def _like_names(records: list[tuple[str, list[str]]]) -> tuple[set[str], set[str]]:
    """(written like names, capitalised and too rare to tell), by how words in mid sentence are written.

    Names are everyone's, so most of their capitals stand in records of other languages than German; words whose
    capitals stand in German records are German nouns."""
    capital, small, german = Counter(), Counter(), Counter()
    for code, tokens in records:
        for before, word in zip(tokens, tokens[1:], strict=False):
            if before and before[-1] in ".!?:\"”…" or not word[:1].isalpha() or word.isupper() and len(word) > 1:
                continue
            w = word.lower()
            if word[0].isupper():
                (german if code == "de" else capital)[w] += 1
            else:
                small[w] += 1
    known = {w: capital[w] + german[w] for w in {*capital, *german} if capital[w] + german[w] > 2 * small[w]}
    names = {w for w, n in known.items() if 2 * capital[w] >= n}
    return names, {w for w, n in known.items() if w not in names and n == 1}


def train(records: list[tuple[str, str, list[str]]], epochs: int = EPOCHS, seed: int = 1) -> Model:
    """records: (code, tok_lang, tokens). With none, the model knows the lexicon only."""
    rng = np.random.default_rng(seed)
    weights = np.zeros((PAD + 1, STATES), np.float32)
    for k in range(NONE):
        weights[BUCKETS + k, k] = 3.0
    same = np.arange(CHAIN) % NONE
    transitions = np.where(same[:, None] == same[None, :], 0.0, -4.0)
    model = Model(weights, transitions, np.zeros(CHAIN))
    if not records:
        return model
    names, maybe = _like_names([(c, t) for c, _, t in records])  # robust to wrong labels: majorities count
    texts = [(LANGUAGES.index(code), [w for w in text.split(" ") if w]) for code, text, _ in records]
    texts = [(k, w) for k, w in texts if w]
    texts = _plausible(texts, names)
    for phase in range(2):
        if not texts:
            break
        if phase:  # records that the model reads otherwise than they are labelled, or as mixed, teach nothing more
            texts = [x for x, p in zip(texts, _decode(model, [w for _, w in texts]), strict=True) if _agrees(x[0], p)] or texts
        # Two records of different languages one after the other teach how languages change within a record.
        rows = [([k] * len(w), w) for k, w in texts]
        for _ in range(len(texts) // 6):
            (k, v), (m, w) = (texts[i] for i in rng.integers(0, len(texts), 2))
            rows.append(([k] * len(v) + [m] * len(w), v + w))
        _fit(model, rows, names, maybe, epochs // 2 if not phase else epochs - epochs // 2)
    return model


def _plausible(texts: list[tuple[int, list[str]]], names: set[str]) -> list[tuple[int, list[str]]]:
    """Records whose label is the likeliest given their words, by word counts over the others (naive Bayes, each record
    left out of its own counts). A wrong label would else pull all words of its record towards itself."""
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in texts for w in ws if w not in names))}
    counts = np.full((len(vocabulary), NONE), 0.01)
    sets = [np.array(sorted({vocabulary[w] for w in ws if w in vocabulary}), np.int64) for _, ws in texts]
    records = np.full(NONE, 1.0)
    for (k, _), s in zip(texts, sets, strict=True):
        counts[s, k] += 1
        records[k] += 1
    kept = []
    for x, s in zip(texts, sets, strict=True):
        own = counts[s].copy()
        own[:, x[0]] -= 1
        best = (np.log(own) - np.log(records)).sum(axis=0).argmax() if len(s) else x[0]
        if best == x[0]:
            kept.append(x)
    return kept


def _agrees(k: int, posterior: np.ndarray) -> bool:
    counts = np.bincount(posterior.argmax(axis=1), minlength=STATES)[:NONE]
    return counts.sum() == 0 or counts.argmax() == k and counts.sum() - counts[k] <= 1


def _fit(model: Model, rows: list[tuple[list[int], list[str]]], names: set[str], maybe: set[str], epochs: int) -> None:
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in rows for w in ws))}
    words = list(vocabulary)
    shown = [plain(w) for w in words]
    script = script_scores(words)
    kind = np.zeros(len(words), np.int8)  # 0 the record's language, 1 none, 2 either, 3.. the lexicon's
    for i, w in enumerate(shown):
        kind[i] = 3 + _LEX[w] if w in _LEX else 1 if words[i] in names or not any(c.isalpha() for c in w) else 2 if words[i] in maybe else 0
    blocks = list(_by_length(shown))
    lengths = np.array([len(w) for _, w in rows])
    code = [np.array([vocabulary[w] for w in ws]) for _, ws in rows]
    label = [np.array(ks) for ks, _ in rows]
    batches = []
    for picked in _batches(lengths, 30_000):
        t = int(lengths[picked].max())
        c, y = np.zeros((len(picked), t), np.int64), np.zeros((len(picked), t), np.int64)
        for r, i in enumerate(picked):
            c[r, : lengths[i]], y[r, : lengths[i]] = code[i], label[i]
        allowed = np.zeros((*c.shape, CHAIN), bool)
        kinds = kind[c]
        np.put_along_axis(allowed, np.where(kinds >= 3, kinds - 3, np.where(kinds == 1, NONE + y, y))[:, :, None], True, axis=2)
        np.put_along_axis(allowed, np.where(kinds == 2, NONE + y, allowed.argmax(axis=2))[:, :, None], True, axis=2)
        # Where the record's language isn't written in the word's script, the word may have any other label.
        allowed[(script[c, y] < 0) & (kinds != 1) & (kinds < 3)] = True
        batches.append((c, allowed, lengths[picked]))
    params = [model.weights, model.transitions, model.start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = float(lengths.sum())
    pool = ThreadPoolExecutor(max(1, min(8, os.cpu_count() or 1)))  # numpy's loops run beside each other
    for step in range(1, epochs + 1):
        emissions = np.zeros((len(words), STATES), np.float32)
        for where, index, weight in blocks:
            emissions[where] = np.einsum("vfs,vf->vs", model.weights[index], weight)
        emissions += script
        chain = spread(emissions)

        def part(batch: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            c, allowed, n = batch
            scores = chain[c]  # noqa: B023
            free = forward_backward(scores, n, model.transitions, model.start)
            bound = forward_backward(np.where(allowed, scores, -1e4), n, model.transitions, model.start)
            error, flat = gather(bound[0] - free[0]).reshape(-1, STATES), c.ravel()
            return np.stack([np.bincount(flat, weights=error[:, s], minlength=len(words)) for s in range(STATES)], axis=1), bound[1] - free[1], bound[2] - free[2]

        by_word, by_pair, by_start = (sum(x) for x in zip(*pool.map(part, batches), strict=True))  # in the order of the batches

        def by_state(s: int) -> np.ndarray:
            return sum(np.bincount(index.ravel(), weights=(by_word[where, s, None] * weight).ravel(), minlength=PAD + 1) for where, index, weight in blocks)  # noqa: B023

        gradient = np.stack(list(pool.map(by_state, range(STATES))), axis=1)
        grads = [gradient / total - 2e-7 * model.weights, by_pair / total, by_start / total]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            # The floor keeps features of few words from moving as far as those of many.
            p += (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + FLOOR)).astype(p.dtype)
        model.weights[PAD] = 0
    pool.shutdown()


def _decode(model: Model, records: list[list[str]]) -> list[np.ndarray]:
    """Posterior marginals (words, STATES) of each record; none of the records may be empty."""
    codes, names = pd.factorize(np.array([w for r in records for w in r], dtype=object))
    emissions = spread(model.emissions(list(names)))
    lengths = np.array([len(r) for r in records])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    out: list[np.ndarray] = [np.zeros((0, STATES))] * len(records)
    for picked in _batches(lengths, 120_000):
        t = int(lengths[picked].max())
        where = np.minimum(starts[picked][:, None] + np.arange(t)[None, :], len(codes) - 1)
        gamma = forward_backward(emissions[codes[where]], lengths[picked], model.transitions.astype(np.float32), model.start.astype(np.float32))[0]
        gamma = gather(gamma)
        for r, i in enumerate(picked):
            out[i] = gamma[r, : lengths[i]]
    return out


def passages(states: np.ndarray, repeated: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first, past, state, words) runs of one language; words without language neither count nor interrupt, and one
    or two words of another language between two runs of the same language are borrowed ones. A word that only
    repeats the one before it doesn't count again."""
    runs: list[list[int]] = []
    for i in np.flatnonzero(states != NONE):
        if runs and runs[-1][2] == states[i]:
            runs[-1][1], runs[-1][3] = i + 1, runs[-1][3] + (not repeated[i])
        else:
            runs.append([i, i + 1, states[i], 1])
    out: list[list[int]] = []
    for run in runs:  # one pass: a run may close over the short one between it and the last of its language
        out.append(run)
        while len(out) >= 3 and out[-2][3] <= 2 and out[-3][2] == out[-1][2]:
            last = out.pop()
            out.pop()
            out[-1][1], out[-1][3] = last[1], out[-1][3] + last[3]
    return [tuple(int(x) for x in r) for r in out]


LABELLED = "id long, lang string, confidence double, n_words int, passages array<struct<first:int,past:int,lang:string,words:int,confidence:double>>"


def _labeller(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = [[w for w in t.split(" ") if w] if t else [] for t in frame["text"]]
            some = [i for i, w in enumerate(words) if w]
            posterior = dict(zip(some, _decode(model, [words[i] for i in some]), strict=True)) if some else {}
            rows = []
            for i, id_ in enumerate(frame["id"]):
                p = posterior.get(i)
                if p is None:
                    rows.append((id_, None, None, 0, []))
                    continue
                states = p.argmax(axis=1)
                sure = p.max(axis=1)
                again = np.array([False, *(a == b for a, b in zip(words[i], words[i][1:], strict=False))])
                runs = passages(states, again)
                found = [{"first": a, "past": z, "lang": LANGUAGES[s], "words": n, "confidence": float(sure[a:z][states[a:z] == s].mean())} for a, z, s, n in runs]
                mass = p[~again, :NONE].sum(axis=0)
                if (states != NONE).any():
                    best = int(mass.argmax())
                    rows.append((id_, LANGUAGES[best], float(mass[best] / mass.sum()), len(states), found))
                else:
                    rows.append((id_, None, None, len(states), found))
            yield pd.DataFrame(rows, columns=["id", "lang", "confidence", "n_words", "passages"])

    return run


def fit(df: DataFrame, id_col: str = "ord", text_col: str = "tok_lang", tokens_col: str = "tokens", label_col: str = "lang_det", max_records: int = MAX_TRAINING_RECORDS) -> Model:
    """The model trained on at most ``max_records`` records with a usable label, chosen by a hash of their id."""
    from loomline.plans.lineage import bounded_sample

    usable = df.where(F.col(id_col).isNotNull() & F.lower(F.trim(label_col)).rlike(f"^({'|'.join(_CODES)})([-_].*)?$"))
    # Ids are chosen first, so that texts and tokens move for the chosen records only.
    chosen = [r[id_col] for r in bounded_sample(usable.select(id_col).distinct(), id_col, max_records).collect()]
    picked = df.sparkSession.createDataFrame([(i,) for i in chosen], f"{id_col} {dict(df.dtypes)[id_col]}")
    rows = usable.join(F.broadcast(picked), id_col, "left_semi").where(F.col(text_col).isNotNull() & F.col(tokens_col).isNotNull())
    rows = {r[id_col]: r for r in rows.select(id_col, text_col, tokens_col, label_col).collect()}  # redeliveries fold
    return train([(label_code(rows[i][label_col]), rows[i][text_col], [t for t in rows[i][tokens_col] if t]) for i in chosen if i in rows])


def label_languages(df: DataFrame, model: Model, id_col: str = "ord", text_col: str = "tok_lang") -> DataFrame:
    """(id, lang, confidence, n_words, passages) for every row. A null, empty or wordless text has null language.

    Passages give their word positions (past is exclusive), their language, the number of words in it and the mean
    posterior of those words. The record's language is the one with the greatest sum of posteriors, its confidence the
    share of that sum; equal sums go to the first in the order of LANGUAGES.
    """
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(_labeller(model), LABELLED)


def languages(df: DataFrame) -> DataFrame:
    """(ord, lang, confidence, n_words, passages), each tweet once."""
    from loomline.plans.lineage import once_per_key

    return label_languages(once_per_key(df.select("ord", "tok_lang"), "ord"), fit(df)).withColumnRenamed("id", "ord")


def found(df: DataFrame) -> DataFrame:
    """(ord, lang): tweets whose label is missing or wrong, with the language of their words, and mixed tweets with
    each language that has a passage of five words or more."""
    from loomline.plans.lineage import once_per_key

    # The label travels along with the text, so that no join is needed afterwards.
    return once_per_key(df.select("ord", "lang_det", "tok_lang"), "ord").mapInPandas(_judge(fit(df)), "ord long, lang string")


def _judge(model: Model):
    run = _labeller(model)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for part in run(iter([frame.rename(columns={"ord": "id", "tok_lang": "text"})])):
                for id_, label, lang, n, runs in zip(part["id"], frame["lang_det"], part["lang"], part["n_words"], part["passages"], strict=True):
                    if lang is None:
                        continue
                    long = dict.fromkeys(r["lang"] for r in runs if r["words"] >= 5)
                    if len(long) >= 2:
                        out += [(id_, x) for x in long]
                        continue
                    of = lambda x: sum(r["words"] for r in runs if r["lang"] == x)
                    if n >= 5 and label_code(label) != lang and of(lang) >= 2 and of(lang) > of(label_code(label)):
                        out.append((id_, lang))
            yield pd.DataFrame(out, columns=["ord", "lang"])

    return judge
