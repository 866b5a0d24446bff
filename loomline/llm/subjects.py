"""Problem 8: the subject areas of each document.

Method: labelling functions and an accuracy-learning latent model. Functions vote on every sentence: the words of the
subjects' descriptions, a lexicon learned from labelled documents (sure and unsure votes apart), addresses and tags, the
section (headline), the source, and the rest of the document. None of their votes is taken as truth:
expectation-maximisation learns each function's accuracy, and a sentence's subject comes from the posterior. Functions
that draw on the same lexicon are one family of which one speaks for all, since what misleads one misleads the others: the
sentence's own sure words, or else the most accurate of the rest. A document gets the subjects that hold enough of its sentences.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.tokens import sample_texts

#: Bounds of the fit: labelled documents, other documents, bytes of the texts of each, rounds in all and on labelled ones.
MAX_LABELLED, MAX_LABELLED_BYTES = 4000, 24 << 20
MAX_OTHER, MAX_OTHER_BYTES = 3000, 16 << 20
ROUNDS, ALONE = 10, 8
#: How much a class with few sentences in a language is raised there at most.
MOST = 20.0
#: What a labelled document's sentences may still weigh for subjects that its labels don't name.
STRICT = 1e-6
#: Closing lines are sentences found again word for word at the end of this share of the documents, and hardly elsewhere;
#: stock sentences those found in this share of them. So the lists have 2,000 and 500 times as many entries at most as
#: a document has sentences on average.
CLOSING, STOCK = 0.0005, 0.002
#: A word is one of everyday life if it is so many times as frequent outside the labelled documents, significantly.
EVERYDAY_RATIO, SIGNIFICANT = 2.0, 10.83
#: A word tells a subject if this share of its labelled documents have that label; one of everyday life stands beside such
#: words in no more than that share of its sentences.
SOLE, BESIDE = 0.6, 0.25
#: A sentence's learned-lexicon vote is sure from this log odds on.
SURE = 3.0
SHARE = 0.25

_DATELINE = re.compile(r"^[^\W\d_][^a-z,]*, \d{1,2}\.? [^\W\d_]+ [-–—] ")
_END = re.compile(r"(?<=[.!?…])\s+|(?<=[.!?…][\"”»'])\s+")
_ADDRESS = re.compile(r"https?://(\S+)|#(\w+)")
_WORD = re.compile(r"[^\W\d_]+")
_BREAK, _MARKUP, _TAGS = re.compile(r"<(br|p)\s*/?>|</p>"), re.compile(r"<[^<>]{1,40}>"), re.compile(r"[#@]\w+")
_PARAGRAPH = re.compile(r"\n\s*\n")


@dataclass
class Page:
    headline: str | None
    sentences: list[str]
    tail: int  # how many of the sentences form the last paragraph, 0 if there is only one paragraph


def split_page(text: str) -> Page:
    """Headline, sentences without dateline and left-over markup, and the size of the last paragraph."""
    if "<" in text:
        text = _MARKUP.sub(" ", _BREAK.sub("\n\n", text))
    if "&" in text:
        text = html.unescape(text)
    paragraphs = [[x for x in (line.strip().lstrip("*•-").strip() for line in p.split("\n")) if x] for p in _PARAGRAPH.split(text)]
    paragraphs = [p for p in paragraphs if p]
    headline = None
    if paragraphs:
        first = _DATELINE.sub("", paragraphs[0][0])
        if len(paragraphs) > 1 and len(paragraphs[0]) == 1 and not re.search(r"[.!?…][\"”»']?(\s+#\w+)*$", first):
            headline, paragraphs = first, paragraphs[1:]
            first = _DATELINE.sub("", paragraphs[0][0])
        paragraphs[0][0] = first
    sentences, tail = [], 0
    for p in paragraphs:
        tail = 0
        for line in p:
            for s in _END.split(line):
                if _WORD.search(_TAGS.sub("", s) if "#" in s or "@" in s else s):
                    sentences.append(s)
                    tail += 1
                elif sentences and s.strip():
                    sentences[-1] += " " + s  # tags after the last mark belong to the sentence
    return Page(headline, sentences, tail if len(paragraphs) > 1 or headline and paragraphs else 0)


def sentence_key(sentence: str) -> int:
    """A 63-bit key of a sentence."""
    return int.from_bytes(hashlib.blake2b(sentence.encode(), digest_size=8).digest()) >> 1


def strip_footer(page: Page, footers: set[int]) -> list[str]:
    """The sentences without those of the last paragraph that are closing lines."""
    if not page.tail:
        return page.sentences
    body, last = page.sentences[: -page.tail], page.sentences[-page.tail :]
    return body + [s for s in last if sentence_key(s) not in footers]


def count_sentences(pages: Iterator[Page]) -> tuple[Counter, Counter]:
    """How often each sentence (by key) is found in the last paragraph, and before."""
    last, before = Counter(), Counter()
    for p in pages:
        cut = len(p.sentences) - p.tail
        before.update(map(sentence_key, p.sentences[:cut]))
        last.update(map(sentence_key, p.sentences[cut:]))
    return last, before


def repeated(counts: list[tuple[int, int, int]], documents: int) -> tuple[set[int], set[int]]:
    """(closing lines, stock sentences) from (key, times in the last paragraph, times before)."""
    closing = {k for k, at_end, before in counts if at_end >= max(3, CLOSING * documents) and before <= 0.1 * at_end}
    return closing, {k for k, at_end, before in counts if k not in closing and at_end + before >= max(4, STOCK * documents)}


def words_of(sentence: str) -> list[str]:
    if "#" in sentence or "://" in sentence:
        sentence = _ADDRESS.sub(" ", sentence)
    return _WORD.findall(sentence.lower())


def source_key(source: str | None) -> str | None:
    """A source's name in one spelling."""
    return re.sub(r"[\s_]+", " ", source).strip().lower() if source and source.strip() else None


FUNCTIONS = ("description", "sure words", "unsure words", "address", "section", "source", "document")
#: The functions that draw on the learned lexicon; the first speaks for the others.
FAMILY = (1, 2, 4, 6)


@dataclass
class Model:
    subjects: list[str]
    words: dict[str, int]
    log_odds: np.ndarray  # (words + 1, classes), class-conditional log probabilities; last row zero
    seeds: dict[str, int]
    footers: set[int]
    stock: set[int]
    addresses: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    accuracy: np.ndarray = field(default_factory=lambda: np.full(len(FUNCTIONS), 0.7))
    balance: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.seed_class = np.full(len(self.words) + 1, -1, np.int64)
        for w, c in self.seeds.items():
            if w in self.words:
                self.seed_class[self.words[w]] = c

    @property
    def classes(self) -> int:
        return len(self.subjects) + 2  # everyday life, and sentences without content

    def lexicon(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by the learned lexicon and numbers of seed words, both (sentences, classes)."""
        sizes = np.fromiter(map(len, sentences), np.int64, len(sentences))
        unknown = len(self.words)
        get = self.words.get
        index = np.array([get(w, unknown) for s in sentences for w in s], np.int64)
        out, seen = np.zeros((len(sentences), self.classes)), np.zeros((len(sentences), self.classes), np.int64)
        row = np.repeat(np.arange(len(sentences)), sizes)
        full = np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(self.log_odds[index], np.r_[0, np.cumsum(sizes[full])[:-1]], axis=0)
        seed = self.seed_class[index]
        np.add.at(seen, (row[seed >= 0], seed[seed >= 0]), 1)
        return out, seen

    def votes(self, pages: list[tuple[str | None, list[str], str | None]]) -> tuple[np.ndarray, np.ndarray]:
        """(document of each sentence, votes): a class for each sentence and function, -1 where it abstains."""
        doc = np.repeat(np.arange(len(pages)), [len(p[1]) for p in pages])
        text = [s for p in pages for s in p[1]]
        tokens = [words_of(s) for s in text]
        out = np.full((len(text), len(FUNCTIONS)), -1, np.int64)
        scores, seen = self.lexicon(tokens)
        best = scores.argmax(axis=1)
        top = np.sort(scores, axis=1)
        margin = top[:, -1] - top[:, -2] if len(text) else np.zeros(0)
        out[:, 1] = np.where(margin >= SURE, best, -1)
        out[:, 2] = np.where((margin < SURE) & (margin > 0), best, -1)
        heads, _ = self.lexicon([words_of(p[0]) if p[0] else [] for p in pages])
        head_top = np.sort(heads, axis=1)
        head_vote = np.where(head_top[:, -1] - head_top[:, -2] >= SURE, heads.argmax(axis=1), -1) if len(pages) else np.zeros(0, np.int64)
        most = seen.max(axis=1)
        out[:, 0] = np.where((most > 0) & ((seen == most[:, None]).sum(axis=1) == 1), seen.argmax(axis=1), -1)
        for i, s in enumerate(text):
            if "#" in s or "://" in s:
                for a in _ADDRESS.finditer(s):
                    out[i, 3] = self.addresses.get((a[1] or a[2]).lower(), out[i, 3])
        source = np.array([self.sources.get(source_key(p[2]) or "", -1) for p in pages], np.int64)
        content = out[:, 1] != self.classes - 1  # section, source and document say nothing on sentences without content
        out[:, 4] = np.where(content, head_vote[doc], -1) if len(text) else out[:, 4]
        out[:, 5] = np.where(content, source[doc], -1) if len(text) else out[:, 5]
        counts = np.zeros((len(pages), self.classes))
        known = out[:, 1] >= 0
        np.add.at(counts, (doc[known], out[known, 1]), 1)
        counts[:, -1] = 0
        if len(text):  # the other sentences of the document; mixed documents say nothing
            others = counts[doc]
            own = np.flatnonzero(known & (out[:, 1] < self.classes - 1))
            others[own, out[own, 1]] -= 1
            sole = (others.max(axis=1) > 0) & (others.max(axis=1) >= 0.9 * others.sum(axis=1))
            out[:, 6] = np.where(content & sole, others.argmax(axis=1), -1)
        return doc, out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        k = self.classes
        log = np.tile(np.log(self.balance if self.balance is not None else np.full(k, 1 / k)), (len(votes), 1))
        spoken = np.zeros(len(votes), bool)
        for j in (*FAMILY[:1], *sorted(FAMILY[1:], key=lambda j: -self.accuracy[j]), *(j for j in range(len(FUNCTIONS)) if j not in FAMILY)):
            heard = (votes[:, j] >= 0) & ~spoken if j in FAMILY else votes[:, j] >= 0
            if j in FAMILY:
                spoken |= heard
            voted, a = np.flatnonzero(heard), self.accuracy[j]
            log[voted, votes[voted, j]] += np.log(a * (k - 1) / (1 - a))
        log = np.exp(log - log.max(axis=1, keepdims=True)) if len(log) else log
        return log / log.sum(axis=1, keepdims=True) if len(log) else log


def _learn_accuracies(model: Model, votes: np.ndarray, allowed: np.ndarray, rounds: int = 25) -> None:
    """Expectation-maximisation of the one-coin model: each function is right at a rate of its own. ``allowed`` says how
    much each sentence may weigh for each class: labelled documents tie the latent subjects to the named ones."""
    k = model.classes
    model.balance = np.full(k, 1 / k)
    model.accuracy = np.array([0.8, 0.9, 0.7, 0.6, 0.6, 0.5, 0.6])
    for _ in range(rounds):
        p = model.posterior(votes) * allowed
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        model.balance = (p.sum(axis=0) + 1) / (len(p) + k)
        for j in range(votes.shape[1]):
            voted = np.flatnonzero(votes[:, j] >= 0)
            right = p[voted, votes[voted, j]].sum()
            model.accuracy[j] = np.clip((right + 1) / (len(voted) + 2), 1 / k, 0.995)


def described(subjects: dict[str, str]) -> dict[str, int]:
    """The words of the subjects' names and descriptions, in the plural and singular, that only one subject has."""
    found: dict[str, int] = {}
    for i, (name, scope) in enumerate(subjects.items()):
        words = {w for w in _WORD.findall(f"{name} {scope}".lower()) if len(w) > 3}
        words |= {w[:-3] + "y" for w in words if w.endswith("ies")} | {w[:-1] for w in words if w.endswith("s") and len(w) > 4}
        for w in words:
            found[w] = i if found.get(w, i) == i else -1
    return {w: c for w, c in found.items() if c >= 0}


def everyday(bodies: list[list[str]], labels: list[tuple[str, ...]]) -> set[str]:
    """Words of everyday life: in significantly more documents outside the labelled ones, which are all about some subject,
    than inside, there not mostly in documents of one subject, and seldom in a sentence with a word that is so."""
    texts = [[set(words_of(s)) for s in body] for body in bodies]
    inside, outside, by_subject = Counter(), Counter(), {}
    for sentences, named in zip(texts, labels, strict=True):
        found = set().union(*sentences)
        (inside if named else outside).update(found)
        for x in named:
            by_subject.setdefault(x, Counter()).update(found)
    a, b = sum(map(bool, labels)), sum(not x for x in labels)
    if not a or not b:
        return set()
    share = {w: max(c[w] for c in by_subject.values()) / n for w, n in inside.items()}
    words = [w for w, n in outside.items() if n >= 5]
    x, y = np.array([inside[w] for w in words], float), np.array([outside[w] for w in words], float)
    mean = (x + y) / (a + b)
    ratio = 2 * (np.where(x > 0, x * np.log(np.maximum(x, 1) / (a * mean)), 0) + y * np.log(y / (b * mean)))
    picked = {w for w, g, u, v in zip(words, ratio, x, y, strict=True) if g > SIGNIFICANT and v / b >= EVERYDAY_RATIO * u / a and (u < 3 or share[w] < SOLE)}
    # Words more frequent outside tell nothing: those come in by documents labelled wrongly.
    telling = {w for w, n in inside.items() if n >= 3 and share[w] >= SOLE and outside[w] / b < EVERYDAY_RATIO * n / a}
    seen, beside = Counter(), Counter()
    for sentences, named in zip(texts, labels, strict=True):
        for s in sentences if not named else ():
            if here := s & picked:
                seen.update(here)
                if not s.isdisjoint(telling):
                    beside.update(here)
    return {w for w in picked if beside[w] < BESIDE * seen[w]}


def train(rows: list[tuple[str, str | None, tuple[str, ...]]], scopes: dict[str, str], closing: set[int] | None = None, stock_keys: set[int] | None = None, languages: list[str | None] | None = None) -> Model:
    """rows: (text, source, hand labels or none); scopes: what each subject covers; languages: of the texts, as far as
    known. Closing lines and stock sentences are found among the rows where they aren't given. Works without labels
    too, from the descriptions alone."""
    subjects = list(scopes)
    k = len(subjects) + 2
    pages = [split_page(t) for t, _, _ in rows]
    if closing is None or stock_keys is None:
        last, before = count_sentences(pages)
        closing, stock_keys = repeated([(s, last[s], before[s]) for s in {*last, *before}], len(rows))
    bodies = [strip_footer(p, closing) for p in pages]
    seeds = described(scopes)
    daily = everyday(bodies, [labels for _, _, labels in rows]) - set(seeds)
    doc = np.repeat(np.arange(len(rows)), [len(b) for b in bodies])
    text = [s for b in bodies for s in b]
    tokens = [words_of(s) for s in text]
    words: dict[str, int] = {w: i for i, w in enumerate([*seeds, *sorted(daily)])}
    for w, n in Counter(w for t in tokens for w in t).items():
        if n >= 2 and w not in words:
            words[w] = len(words)
    sizes = np.array([sum(w in words for w in t) for t in tokens], np.int64)
    index = np.fromiter((words[w] for t in tokens for w in t if w in words), np.int64, int(sizes.sum()))
    row = np.repeat(np.arange(len(text)), sizes)
    # Stock sentences, found again word for word in many documents, have no subject.
    stock = np.array([sentence_key(s) in stock_keys for s in text], bool) if text else np.zeros(0, bool)
    named = np.array([[float(x in labels) for x in subjects] for _, _, labels in rows]).reshape(len(rows), len(subjects))
    labelled = named.any(axis=1)
    allowed = np.ones((len(rows), k))
    allowed[labelled, : len(subjects)] = np.where(named[labelled] > 0, 1, STRICT)
    # To begin with, sentences of labelled documents are about their labels, those with words of everyday life about none;
    # without any labels, sentences are about what the descriptions' words say.
    r = np.zeros((len(text), k))
    for i, t in enumerate(tokens):
        if labelled[doc[i]]:
            r[i, : len(subjects)] = named[doc[i]]
        elif not labelled.any():
            np.add.at(r[i], [seeds[w] for w in t if w in seeds], 1)
        n = sum(w in daily for w in t)
        if n > labelled[doc[i]]:
            r[i], r[i, k - 2] = 0, 1
    r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-12)
    r[labelled[doc]] *= (1 / np.maximum(named.sum(axis=1), 1) ** 2)[doc[labelled[doc]]][:, None]  # sentences of one label teach most
    r[stock] = 0
    r[stock, k - 1] = 1
    log_phi = np.zeros((len(words) + 1, k))
    names = {x: i for i, x in enumerate(dict.fromkeys(languages or [None]))}
    tongue = np.array([names[x] for x in languages], np.int64)[doc] if languages else np.zeros(len(text), np.int64)
    tongues = len(names)
    apart = ~labelled[doc] & (r[:, : k - 1].sum(axis=1) == 0) & ~stock if labelled.any() else np.zeros(len(text), bool)
    for n in range(ROUNDS):
        if n < ALONE:  # first only what is labelled or surely of everyday life teaches, then all sentences
            r[apart] = 0
        # Within a language all classes weigh the same, so that its common words don't speak for the class with most labels.
        mass = np.stack([np.bincount(tongue, weights=r[:, c], minlength=tongues) for c in range(k)], axis=1)
        even = mass.sum(axis=1, keepdims=True) / np.maximum((mass > 0).sum(axis=1, keepdims=True), 1) / np.maximum(mass, 1e-9)
        level = r * np.minimum(even, MOST)[tongue]
        phi = np.stack([np.bincount(index, weights=level[row, c], minlength=len(words)) for c in range(k)], axis=1)
        # A word's rate in a class, smoothed towards its rate overall, so that unseen words say little.
        overall = (phi.sum(axis=1) + 0.1) / (phi.sum() + 0.1 * max(1, len(words)))
        rate = (phi + 30 * overall[:, None] * 0.05 + 0.02 * overall[:, None]) / (phi.sum(axis=0) + 30 * 0.05 + 0.02)
        log_phi[: len(words)] = np.log(np.maximum(rate, 1e-12)) - np.log(np.maximum(overall, 1e-12))[:, None]
        score = np.stack([np.bincount(row, weights=log_phi[index, c], minlength=len(text)) for c in range(k)], axis=1)
        share = np.full((len(rows), k), 0.3)
        np.add.at(share, doc, r)
        share = share / share.sum(axis=1, keepdims=True) * allowed
        log = score + np.log(share[doc]) if len(text) else score
        r = np.exp(log - log.max(axis=1, keepdims=True)) if len(text) else r
        r /= r.sum(axis=1, keepdims=True)
        r[stock] = 0
        r[stock, k - 1] = 1
    model = Model(subjects, words, log_phi, described(scopes), closing, stock_keys)
    by_address: dict[str, np.ndarray] = {}
    for i, s in enumerate(text):
        for a in _ADDRESS.finditer(s):
            by_address.setdefault((a[1] or a[2]).lower(), np.zeros(k))[:] += r[i]
    model.addresses = {a: int(v[: k - 1].argmax()) for a, v in by_address.items() if v.sum() >= 3 and v[: k - 1].max() >= 0.5 * v.sum()}
    by_source: dict[str, np.ndarray] = {}
    for d, (_, source, _) in enumerate(rows):
        if (key := source_key(source)) is not None:
            by_source.setdefault(key, np.zeros(k))[:] += share[d]
    model.sources = {s: int(v[: k - 1].argmax()) for s, v in by_source.items() if v.sum() >= 2}
    of, votes = model.votes([(p.headline, b, s) for p, b, (_, s, _) in zip(pages, bodies, rows, strict=True)])
    taught = labelled[of] if labelled.any() else np.ones(len(of), bool)
    _learn_accuracies(model, votes[taught], allowed[of[taught]])
    model.balance = np.full(k, 1 / k)  # that of all sentences: labelled documents are about subjects more than others
    for _ in range(5):
        p = model.posterior(votes)
        model.balance = (p.sum(axis=0) + 1) / (len(p) + k)
    return model


SCORED = "doc_id long, sentences int, subject string, about int, share double, confidence double"


def _score(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 500):
                frame = whole.iloc[at : at + 500]
                pages = [split_page(t or "") for t in frame["text"]]
                rows = [(p.headline, strip_footer(p, model.footers), s) for p, s in zip(pages, frame["source"], strict=True)]
                doc, votes = model.votes(rows)
                p = model.posterior(votes)
                best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
                out = []
                for c, subject in enumerate(model.subjects):
                    n = np.bincount(doc[best == c], minlength=len(frame))
                    sure = np.bincount(doc[best == c], weights=p[best == c, c], minlength=len(frame))
                    for d in np.flatnonzero(n):
                        size = len(rows[d][1])
                        out.append((frame["doc_id"].iloc[d], size, subject, int(n[d]), n[d] / size, sure[d] / n[d]))
                yield pd.DataFrame(out, columns=["doc_id", "sentences", "subject", "about", "share", "confidence"])

    return run


def _repeated_sentences(texts: DataFrame) -> tuple[set[int], set[int]]:
    """``repeated`` over all documents; only keys and counts are shuffled, and only the frequent ones are gathered."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            last, before = count_sentences(split_page(t) for t in frame["text"])
            keys = [*{*last, *before}]
            yield pd.DataFrame({"key": keys, "at_end": [last[k] for k in keys], "before": [before[k] for k in keys]}, dtype="int64")

    counts = texts.select("text").mapInPandas(run, "key long, at_end long, before long").groupBy("key").agg(F.sum("at_end").alias("at_end"), F.sum("before").alias("before"))
    n = texts.count()
    often = counts.where((F.col("at_end") >= F.lit(max(3.0, CLOSING * n))) | (F.col("at_end") + F.col("before") >= F.lit(max(4.0, STOCK * n))))
    return repeated([tuple(r) for r in often.collect()], n)


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> Model:
    """Trained on at most MAX_LABELLED labelled and MAX_OTHER other documents, with texts of at most MAX_LABELLED_BYTES and
    MAX_OTHER_BYTES, chosen by a hash of their id; closing lines and stock sentences come from all documents."""
    from loomline.plans.lineage import spread_small

    scopes = {r.s: r.scope or "" for r in subjects.where("subject is not null").select(F.lower(F.trim("subject")).alias("s"), "scope").orderBy("s", "scope").collect()}
    hand = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set(F.lower(F.trim("subject"))).alias("labels"))
    texts = documents.select("doc_id", "text", "source", F.lower(F.trim("lang")).alias("lang") if "lang" in documents.columns else F.lit(None).cast("string").alias("lang")).where("doc_id is not null and text is not null")
    labelled = sample_texts(texts.join(hand, "doc_id"), "doc_id", MAX_LABELLED, MAX_LABELLED_BYTES)
    other = sample_texts(texts.join(hand.select("doc_id"), "doc_id", "left_anti"), "doc_id", MAX_OTHER, MAX_OTHER_BYTES)
    rows = sorted([(r.doc_id, r.text, r.source, tuple(sorted(r.labels)), r.lang) for r in labelled] + [(r.doc_id, r.text, r.source, (), r.lang) for r in other], key=lambda r: (r[0], r[1]))
    return train([r[1:4] for r in rows], scopes, *_repeated_sentences(spread_small(texts)), [r[4] for r in rows])


def subject_shares(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, sentences, subject, about, share, confidence): for each document and subject that any of its
    sentences is about, how many are. A row without an id and a text without sentences give no row."""
    from loomline.plans.lineage import spread_small

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source")).where("doc_id is not null")
    return spread_small(rows).mapInPandas(_score(model), SCORED)


def found(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject): subjects that at least a quarter of a document's sentences are about."""
    shares = subject_shares(documents, fit(documents, labels, subjects))
    return shares.where(F.col("share") >= SHARE).select("doc_id", "subject").distinct()


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, documents, sentences): the make-up of the corpus by subject; 'none' for documents about none."""
    shares = subject_shares(documents, fit(documents, labels, subjects)).where(F.col("share") >= SHARE)
    by = shares.groupBy("subject").agg(F.count_distinct("doc_id").alias("documents"), F.sum("about").alias("sentences"))
    none = documents.join(shares.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.lit("none").alias("subject"), F.count(F.lit(1)).alias("documents"), F.lit(0).cast("long").alias("sentences"))
    return by.unionByName(none)
