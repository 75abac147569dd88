"""Subject areas of documents: classifier chains over term and structure features.

1. Sentences.  A text is cut into sentences; headings, running titles and the list of
   references are no sentences.  The title and source of a document are not read.
2. Terms.  Words carry a log-lift for each subject: how much more often a sentence with the
   word is about the subject than any sentence.  Lifts come first from the labelled
   examples, then from the counts of words over all sentences of the whole corpus, each
   sentence weighted by what the first lifts say about the rest of its document.  A word that
   turns up in documents of every subject, as in a figure of speech, so has no lift.
   (Word pairs were tried and left out: on held-out examples they added nothing.)
3. Chain.  Each subject, the more frequent first, has a logistic model over terms (lift of the subject's terms a
   sentence, occurrences of its terms), structure (share of sentences about it and its distance from a cut learnt from the
   examples, sentences, list items, undecided sentences) and the
   subjects already decided before it in the chain; features of the examples are cross-fitted and the
   probabilities calibrated on the same held-out folds.
4. Decoding.  A beam search over the chain finds the most probable combination of subjects.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import Scratch

#: Labelled examples are fitted on the driver; more than this many are refused rather than cut.
MOST_EXAMPLES = 50_000
#: A term must make up this part of all sentences, and occur at least LEAST_SENTENCES times, to be learnt from the corpus: bounds the table.
LEAST_PART = 5e-5
LEAST_SENTENCES = 4
LEAST_WORDS = 5  # of a sentence; shorter pieces are headings, page numbers and crumbs of lists
ABOUT = 1.6  # summed lift from which a sentence is about a subject
SMOOTHING = 1.5
PURE = 0.5  # smoothed part of a word's sentences that must count for its first subject
LEAST_KNOWN = 0.15  # share of decided sentences from which a document teaches its other terms
BEAM = 8

# Words that head a list of references, and abbreviations whose dot ends no sentence.
_REFERENCES = re.compile(r"(?:^|\n)[ \t#*\d.]*(?:references|bibliography|works cited|literatur|literaturverzeichnis|références|bibliographie|referencias|bibliografía)[ \t]*:?[ \t]*\n")
_ENTRY = re.compile(r"\s*(?:\[[^\]\n]{1,12}\]|\d{1,3}[.)]\s|[-*•]\s)|.*\b(?:1[6-9]|20)\d\d[a-z]?\b|.*\bdoi\b")
_REFERENCE_STEMS = ("referen", "référen", "bibliogra", "literatur", "works cited")
_ABBREVIATIONS = frozenset("e g i cf eq eqs dr mr mrs ms prof al z b vol fig figs abb no nr pp vs bzw".split())
_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*|[.!?](?=[\s\"'”’)\]]|$)|\n\s*\n|\n(?=\s*(?:[-*#•]\s|\d+\.\s))")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-\n(?=[^\W\d_])")
_END, _DOT, _UNKNOWN = 0, 1, 2
_RESERVED = 3


def prepare(text: str) -> str:
    """Lower case, one form of line ends and letters, words joined across lines, without the list of references."""
    t = text if text.isascii() else unicodedata.normalize("NFKC", text).replace("­", "").replace("​", "")
    t = t.lower()
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    if "-\n" in t:
        t = _HYPHEN.sub("", t)
    return without_references(t) if any(w in t for w in _REFERENCE_STEMS) else t


def without_references(t: str) -> str:
    """The text without lists of references: such a heading, and the paragraphs behind it whose first two lines look like entries."""
    kept, at = [], 0
    for head in _REFERENCES.finditer(t):
        if head.start() < at:
            continue
        kept.append(t[at : head.start()])
        at = head.end()
        while at < len(t):
            end = t.find("\n\n", at)
            end = len(t) if end < 0 else end + 2
            paragraph = t[at:end]
            lines = paragraph.strip().split("\n", 2)[:2]
            if lines[0].startswith("#") or (paragraph.strip() and not any(_ENTRY.match(x) for x in lines)):
                kept.append("\n\n")
                break
            at = end
    kept.append(t[at:])
    return "".join(kept)


class Words(dict):
    """Numbers words; the first numbers are kept for sentence ends and unknown words."""

    def __init__(self, words: list[str] | None = None, grow: bool = False):
        super().__init__()
        self.list: list[str] = []
        self.grow = grow
        for w in words or []:
            self._add(w)

    def _add(self, word: str) -> int:
        self[word] = n = len(self.list) + _RESERVED
        self.list.append(word)
        return n

    def __missing__(self, word: str) -> int:
        if word[0] == "\n" or word in "!?":
            return _END
        if word == ".":
            return _DOT
        if not self.grow or word.isdigit():
            return _UNKNOWN
        return self._add(word)


@dataclass
class Sentences:
    """Words of many documents one after the other, each with its sentence; sentences know their document."""

    word: np.ndarray
    sentence: np.ndarray
    document: np.ndarray  # of each sentence
    listed: np.ndarray  # share of list lines of each document
    n_documents: int


def read_sentences(texts: list[str | None], words: Words, short: np.ndarray) -> Sentences:
    """``short[w]``: word w is an abbreviation or single letter, after which a dot ends no sentence."""
    codes: list[int] = []
    counts, listed = [], []
    find, number = _TOKEN.findall, words.__getitem__
    for t in texts:
        found = find(prepare(t)) if t else []
        codes.extend(map(number, found))
        codes.append(_END)
        counts.append(len(found) + 1)
        listed.append((t.count("\n- ") + t.count("\n* ")) / (1 + t.count("\n")) if t else 0.0)
    code = np.array(codes, dtype=np.int64)
    document = np.repeat(np.arange(len(texts)), counts)
    if words.grow and len(short) < len(words.list) + _RESERVED:
        short = short_words(words)
    before = np.concatenate([[_END], code[:-1]])
    ends = (code == _END) | ((code == _DOT) & ~short[before])
    inside = ~(ends | (code == _DOT))
    number_of = np.cumsum(ends) - ends
    per = np.bincount(number_of[inside], minlength=int(number_of[-1]) + 1 if len(number_of) else 1)
    real = per >= LEAST_WORDS
    renumber = np.cumsum(real) - 1
    keep = inside & real[number_of]
    document_of = np.zeros(len(per), dtype=np.int64)
    document_of[number_of] = document
    return Sentences(code[keep], renumber[number_of[keep]], document_of[real], np.array(listed), len(texts))


def short_words(words: Words) -> np.ndarray:
    return np.array([False] * _RESERVED + [w in _ABBREVIATIONS or (len(w) == 1 and not w.isdigit()) for w in words.list] + [False])


@dataclass
class TermTable:
    """Log-lift of words for each subject; row w belongs to the word with that number."""

    words: list[str]
    lift: np.ndarray  # (_RESERVED + words, subjects)
    _words: Words | None = field(default=None, repr=False)
    _short: np.ndarray | None = field(default=None, repr=False)

    def vocabulary(self) -> tuple[Words, np.ndarray]:
        if self._words is None:
            self._words = Words(self.words)
            for w in sorted(_ABBREVIATIONS | set("abcdefghijklmnopqrstuvwxyz")):  # a dot after them ends no sentence
                if w not in self._words:
                    self._words._add(w)
            self._short = short_words(self._words)
        return self._words, self._short

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_words": None, "_short": None}


def sentence_scores(s: Sentences, t: TermTable) -> np.ndarray:
    """Summed lifts (sentences x subjects)."""
    n, k = len(s.document), t.lift.shape[1]
    useful = np.append(np.abs(t.lift).max(axis=1) > 0, False)
    pick = useful[np.minimum(s.word, len(t.lift))]
    rows, found = s.sentence[pick], t.lift[s.word[pick]]
    return np.stack([np.bincount(rows, weights=found[:, j], minlength=n) for j in range(k)], axis=1) if n else np.zeros((0, k))


def about(scores: np.ndarray) -> np.ndarray:
    """The subject of each sentence; -1 where none reaches ABOUT."""
    if not len(scores):
        return np.zeros(0, dtype=np.int64)
    best = scores.argmax(axis=1)
    return np.where(scores[np.arange(len(scores)), best] >= ABOUT, best, -1)


@dataclass
class Evidence:
    """What the chain sees of each document; the first three have a column for each subject."""

    share: np.ndarray  # of its sentences
    lift: np.ndarray  # mean of the positive summed lifts of its sentences
    terms: np.ndarray  # occurrences of terms that speak for the subject, as a logarithm
    n: np.ndarray  # sentences
    listed: np.ndarray  # share of list lines

    def rows(self, pick: np.ndarray | slice) -> Evidence:
        return Evidence(*(v[pick] for v in (self.share, self.lift, self.terms, self.n, self.listed)))


def evidence(s: Sentences, t: TermTable) -> Evidence:
    scores, k = sentence_scores(s, t), t.lift.shape[1]
    subject = about(scores)
    n = np.bincount(s.document, minlength=s.n_documents)
    hit = subject >= 0
    flat = np.bincount(s.document[hit] * k + subject[hit], minlength=s.n_documents * k).reshape(s.n_documents, k)
    many = np.maximum(n, 1)[:, None]
    lift = np.stack([np.bincount(s.document, weights=np.maximum(scores[:, j], 0.0), minlength=s.n_documents) for j in range(k)], axis=1) if len(scores) else np.zeros((s.n_documents, k))
    best = np.append(np.where(t.lift.max(axis=1) > 0, t.lift.argmax(axis=1), -1), -1)
    word = np.minimum(s.word, len(t.lift))
    of = best[word] >= 0
    terms = np.bincount(s.document[s.sentence[of]] * k + best[word[of]], minlength=s.n_documents * k).reshape(s.n_documents, k)
    return Evidence(flat / many, lift / many, np.log1p(terms), n, s.listed)


def lifts(by_subject: np.ndarray, total: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log-lift of each subject given a term, smoothed towards none.

    A term counts only if most of its sentences are about one subject: the ordinary words of
    a language that happens to be more frequent in some subject stay out.
    """
    p = (by_subject + SMOOTHING * prior) / (total + SMOOTHING)[:, None]
    lift = np.log(np.maximum(p, 1e-9) / prior)
    return np.where(p.max(axis=1, keepdims=True) >= PURE, np.clip(lift, -2.0, 3.0), 0.0)


def count_words(s: Sentences, weight: np.ndarray, n_words: int) -> np.ndarray:
    """Sums of the weights of the sentences with each word (n_words x (subjects + 1)).

    The last column sums whole sentences that count (their weights are not 0). A word counts once a sentence.
    """
    counted = weight.sum(axis=1) > 0 if len(weight) else np.zeros(0, bool)
    weight = np.column_stack([weight, counted])
    use = counted[s.sentence] & (s.word >= _RESERVED)
    once = np.sort(s.sentence[use].astype(np.int64) * n_words + s.word[use])
    once = once[np.append(True, once[1:] != once[:-1])] if len(once) else once
    sentence, word = once // n_words, once % n_words
    return np.stack([np.bincount(word, weights=weight[sentence, j], minlength=n_words) for j in range(weight.shape[1])], axis=1)


def _table(words: list[str], counts: np.ndarray, prior: np.ndarray) -> TermTable:
    return TermTable(words, lifts(counts[:, :-1], counts[:, -1], prior))


# --- the chain -------------------------------------------------------------------------------


GROUPS = {"share": (1, 2, 3), "terms": (4, 5, 6), "structure": (7, 8, 9, 10)}  # columns of a design; the rest is the chain


def _design(e: Evidence, k: int, decided: np.ndarray, cut: float, left_out: tuple[str, ...] = ()) -> np.ndarray:
    """Features of subject k: shared ones first, then which subjects were decided before it. ``left_out`` names groups that are set to 0."""
    own = e.share[:, k]
    edge = np.clip((own - cut) * np.sqrt(np.maximum(e.n, 1)), -4, 4)
    others = np.delete(e.lift, k, axis=1).max(axis=1)
    rest = np.delete(e.share, k, axis=1).max(axis=1)
    x = np.column_stack([np.ones(len(own)), own, np.clip(own - cut, -0.1, 0.1) * 10, edge, e.lift[:, k], others, e.terms[:, k], rest, 1.0 - e.share.sum(axis=1), np.log1p(e.n), e.listed, decided])
    for group in left_out:
        x[:, list(GROUPS[group]) if group in GROUPS else slice(11, None)] = 0.0
    return x


@dataclass
class Chain:
    """Weights of each subject's logistic model, in the order of the chain, and its calibration (slope, shift)."""

    order: list[int]
    weights: list[np.ndarray]
    calibration: list[tuple[float, float]]
    cut: float
    beam: int = BEAM
    left_out: tuple[str, ...] = ()

    def score(self, at: int, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds."""
        a, b = self.calibration[at]
        return a * (x @ self.weights[at]) + b

    def decode(self, e: Evidence) -> np.ndarray:
        """The most probable combination for each document (documents x subjects), by beam search."""
        docs, k = e.share.shape
        labels = np.zeros((docs, 1, k))
        score = np.zeros((docs, 1))
        for at, subject in enumerate(self.order):
            width = labels.shape[1]
            # A document's own features once, and what was decided before for each combination kept.
            own = self.score(at, _design(e, subject, np.zeros((docs, k)), self.cut, self.left_out))
            before = labels @ (self.calibration[at][0] * self.weights[at][-k:]) if "chain" not in self.left_out else np.zeros((docs, width))
            p = np.clip(1.0 / (1.0 + np.exp(-np.clip(own[:, None] + before, -30, 30))), 1e-9, 1 - 1e-9)
            yes = labels.copy()
            yes[:, :, subject] = 1.0
            both = np.concatenate([labels, yes], axis=1)
            total = np.concatenate([score + np.log1p(-p), score + np.log(p)], axis=1)
            best = np.argsort(-total, axis=1, kind="stable")[:, : self.beam]
            labels = np.take_along_axis(both, best[:, :, None], axis=1)
            score = np.take_along_axis(total, best, axis=1)
        return labels[:, 0, :] * (e.n > 0)[:, None]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, start: np.ndarray | None = None, rounds: int = 60) -> np.ndarray:
    """Newton's method for a logistic model with a quadratic penalty around ``start``."""
    centre = np.zeros(x.shape[1]) if start is None else start
    w = centre.copy()
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * (w - centre)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def folds(n: int, parts: int = 5) -> np.ndarray:
    """A part for each row, the same on every run and unrelated to the rows' order."""
    return np.random.default_rng(7).permutation(n) % parts


def learnt_cut(e: Evidence, truth: np.ndarray) -> float:
    """The share of sentences from which a subject is more likely than not, all subjects together: where a logistic model over the log-odds of the share turns."""
    hits, n = e.share * e.n[:, None], e.n[:, None]
    odds = np.log((hits + 0.5) / (n - hits + 0.5)).ravel()
    shift, slope = _logistic(np.column_stack([np.ones(len(odds)), odds]), truth.ravel(), np.array([1e-3, 1e-3]))
    return float(1.0 / (1.0 + np.exp(np.clip(shift / slope, -5, 5)))) if slope > 0 else 0.5


def fit_chain(e: Evidence, truth: np.ndarray, left_out: tuple[str, ...] = ()) -> Chain:
    """``e`` must come from lifts that didn't see the rows' own labels."""
    k = truth.shape[1]
    order = sorted(range(k), key=lambda j: (-truth[:, j].sum(), j))
    cut = learnt_cut(e, truth)
    xs, ys = [], []
    for at, j in enumerate(order):
        decided = np.zeros_like(truth)
        decided[:, order[:at]] = truth[:, order[:at]]
        xs.append(_design(e, j, decided, cut, left_out))
        ys.append(truth[:, j])
    shared = xs[0].shape[1] - k
    # All subjects together give the start of the shared weights; each then departs from it as its own rows ask.
    penalty = np.concatenate([np.full(shared, 0.05), np.full(k, 4.0)])
    together = _logistic(np.concatenate(xs), np.concatenate(ys), penalty)
    own = np.concatenate([np.full(shared, 6.0), np.full(k, 4.0)])
    fold = folds(len(truth))
    weights, calibration = [], []
    for x, y in zip(xs, ys):
        held = np.zeros(len(y))
        for f in range(5):
            held[fold == f] = x[fold == f] @ _logistic(x[fold != f], y[fold != f], own, together)
        a, b = _logistic(np.column_stack([held, np.ones(len(held))]), y, np.array([5.0, 5.0]), np.array([1.0, 0.0]))
        weights.append(_logistic(x, y, own, together))
        calibration.append((float(max(a, 0.1)), float(b)))
    return Chain(order, weights, calibration, cut, left_out=left_out)


# --- fitting and applying ----------------------------------------------------------------------


@dataclass
class Model:
    subjects: list[str]
    terms: TermTable
    chain: Chain | None

    def label(self, texts: list[str | None]) -> list[list[str]]:
        if self.chain is None or not texts:
            return [[] for _ in texts]
        words, short = self.terms.vocabulary()
        s = read_sentences(texts, words, short)
        return [[self.subjects[j] for j in np.flatnonzero(row)] for row in self.chain.decode(evidence(s, self.terms))]


def example_weights(s: Sentences, n_words: int, words: list[str], truth: np.ndarray, prior: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, TermTable]:
    """Weights of the labelled texts' sentences, and the lifts that follow.

    Each sentence first belongs to all subjects of its text alike, then half to the
    one its words support.  A text without subjects counts for all alike: its words are nobody's.
    """
    doc = truth[s.document]
    spread = np.where(doc.sum(axis=1, keepdims=True) > 0, doc / np.maximum(doc.sum(axis=1, keepdims=True), 1), prior)
    weight = spread
    table = _table(words, count_words(s, weight, n_words), prior)
    for _ in range(rounds):
        scores = sentence_scores(s, table)
        soft = np.exp(scores - scores.max(axis=1, keepdims=True)) * np.where(doc > 0, 1.0, 0.02)
        own = soft / np.maximum(soft.sum(axis=1, keepdims=True), 1e-12)
        weight = np.where(scores.max(axis=1, keepdims=True) >= ABOUT, 0.5 * own + 0.5 * spread, spread)
        table = _table(words, count_words(s, weight, n_words), prior)
    return weight, table


def corpus_weights(s: Sentences, table: TermTable, k: int) -> np.ndarray:
    """What each sentence of unlabelled documents counts for each subject; rows sum to 1, or to 0 where nothing is known.

    A sentence counts for what the *other* sentences of its document are about, never for its own decision, or a word that was
    wrongly learnt would confirm itself.
    """
    subject = about(sentence_scores(s, table))
    n_sentences = np.bincount(s.document, minlength=s.n_documents)
    hit = subject >= 0
    counts = np.bincount(s.document[hit] * k + subject[hit], minlength=s.n_documents * k).reshape(s.n_documents, k).astype(float)
    others = counts[s.document]
    others[np.flatnonzero(hit), subject[hit]] -= 1.0
    known = others.sum(axis=1)
    told = known >= np.maximum(1.0, LEAST_KNOWN * n_sentences[s.document])
    return np.where(told[:, None], others / np.maximum(known, 1.0)[:, None], 0.0)


_FLUSH = 400_000  # words a task gathers before it hands its counts on
_ALL = ""  # the row that counts sentences


def _slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[list[str | None]]:
    """Parts of a batch with a bounded number of bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield texts.slice(a, b - a).to_pylist()


def _count_batches(sent: object, k: int):
    names = ["word", *(f"c{j}" for j in range(k + 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        words, total, sentences = Words(table.words, grow=True), np.zeros((0, k + 1)), 0.0

        def rows() -> pa.RecordBatch:
            used = np.flatnonzero(total[:, -1] > 0)
            word = [_ALL, *(words.list[i - _RESERVED] for i in used.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(word, pa.string())] + [pa.array(np.append(sentences if j == k else 0.0, total[used, j])) for j in range(k + 1)], names)

        for batch in batches:
            for texts in _slices(batch.column(0)):
                s = read_sentences(texts, words, np.zeros(0, bool))
                weight = corpus_weights(s, table, k)
                counts = count_words(s, weight, len(words.list) + _RESERVED)
                counts[: len(total)] += total
                total, sentences = counts, sentences + float((weight.sum(axis=1) > 0).sum())
                if len(total) > _FLUSH:
                    yield rows()
                    words, total, sentences = Words(table.words, grow=True), np.zeros((0, k + 1)), 0.0
        if len(total):
            yield rows()

    return run


def corpus_counts(documents: DataFrame, text: str, table: TermTable, k: int, examples: list[str]) -> tuple[list[str], np.ndarray]:
    """Words of the whole corpus with their counts: those of the examples, and others that lean to one subject.

    All sentences of all documents are counted; tasks hand on one row a word.  Of words that no example holds only those
    in more than LEAST_PART of the sentences come to the driver, so at most
    (words a sentence) / LEAST_PART of them whatever the size of the corpus; the examples' are bounded by MOST_EXAMPLES.
    """
    spark = documents.sparkSession
    names = [f"c{j}" for j in range(k + 1)]
    counted = documents.select(F.col(text).alias("text")).mapInArrow(_count_batches(spark.sparkContext.broadcast(table), k), "word string, " + ", ".join(f"{c} double" for c in names))
    by_word = Scratch(spark, "subjects").write(counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in names)), "words")
    every = by_word.where(F.col("word") == _ALL).select(names[-1]).first()
    least = max(LEAST_SENTENCES, LEAST_PART * (every[0] if every else 0.0))
    lean = F.greatest(*(F.col(c) for c in names[:-1])) >= (PURE - 0.2) * F.col(names[-1])
    known = spark.createDataFrame([(w, True) for w in examples], "word string, known boolean")
    marked = by_word.where(F.col("word") != _ALL).join(known, "word", "left")
    kept = marked.where(F.coalesce("known", F.lit(False)) | ((F.col(names[-1]) >= least) & lean)).drop("known").orderBy("word").toPandas()
    return kept["word"].tolist(), kept[names].to_numpy(dtype=float)


def fit(examples: DataFrame, documents: DataFrame, subjects: DataFrame, *, text: str = "text", labels: str = "subjects", left_out: tuple[str, ...] = ()) -> Model:
    """The model of all steps but decoding.

    ``examples`` are labelled rows, at most MOST_EXAMPLES (more raise an error); rows with null text or
    labels and labels that are no subject don't count.  ``documents`` is the whole corpus.  ``left_out`` names groups of
    features to do without (of GROUPS, or "chain"), to measure what they add.
    """
    names = sorted(r[0] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().collect())
    k = len(names)
    rows = examples.where(F.col(text).isNotNull() & F.col(labels).isNotNull()).select(text, labels).limit(MOST_EXAMPLES + 1).collect()
    if len(rows) > MOST_EXAMPLES:
        raise ValueError(f"more than {MOST_EXAMPLES} labelled examples; choose a sample")
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    prior = np.full(max(k, 1), 1.0 / max(k, 1))
    if not rows or k < 2:
        return Model(names, TermTable([], np.zeros((_RESERVED, max(k, 1)))), None)
    truth = np.array([[float(n in r[1]) for n in names] for r in rows])
    words = Words(grow=True)
    s = read_sentences([r[0] for r in rows], words, np.zeros(0, bool))
    weight, first = example_weights(s, len(words.list) + _RESERVED, list(words.list), truth, prior)
    corpus_words, counts = corpus_counts(documents, text, first, k, list(words.list))
    for w in corpus_words:
        if w not in words:
            words._add(w)
    n_words = len(words.list) + _RESERVED
    corpus = np.zeros((n_words, k + 1))
    corpus[[words[w] for w in corpus_words]] = counts
    # The chain learns from features that don't know a row's own label: lifts without the row's part of the examples.
    part = folds(len(rows))
    found = evidence(s, first)
    for f in np.unique(part):
        others = weight * (part[s.document] != f)[:, None]
        held = evidence(s, _table(words.list, corpus + count_words(s, others, n_words), prior))
        for mine, its in ((found.share, held.share), (found.lift, held.lift), (found.terms, held.terms)):
            mine[part == f] = its[part == f]
    table = _table(words.list, corpus + count_words(s, weight, n_words), prior)
    useful = np.abs(table.lift).max(axis=1) > 0
    kept = np.flatnonzero(useful[_RESERVED:])
    lean = TermTable([words.list[i] for i in kept.tolist()], np.concatenate([table.lift[:_RESERVED], table.lift[_RESERVED + kept]]))
    return Model(names, lean, fit_chain(found, truth, left_out))


def subjects_of(documents: DataFrame, model: Model, *, text: str = "text", out: str = "subjects") -> DataFrame:
    """``documents`` with a column ``out``: the subjects of the text, sorted; null, empty and blank texts have none.

    A column of that name is replaced.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<string>")
    def label(texts: pa.Array) -> pa.Array:
        m = sent.value
        found: list[list[str]] = []
        for t in _slices(texts):
            found.extend(m.label(t))
        return pa.array(found, pa.list_(pa.string()))

    # As nondeterministic, an explode of the result doesn't make the optimizer run the model once more in a filter.
    return documents.withColumn(out, label.asNondeterministic()(F.col(text)))
