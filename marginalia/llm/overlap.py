"""Same or nearly the same questions in the training split and in evaluation splits.

1. Each distinct question is brought to its canonical words in reading order: writing, layout, lead-ins
   and small function words don't count, and a slip in an ordinary word is undone.  Which words
   are ordinary, and what a slip was meant to be, is learnt from all questions.
2. Evaluation questions are indexed in shards by a compressed full-text index over words.  Training
   questions are streamed through its backward search: the rarest word that must be there is
   searched, and each place found is extended to the maximal match around it.  What is left of the question is
   matched likewise, and the spans of each pair of texts are merged: a moved phrase shows as a second span.
3. Two questions are the same if their merged spans hold all words of both, in no more than MOST_SPANS runs.
   One word may stay outside on each side, if the two are one slip apart, too rare to be
   ordinary, and neither is a name or number.
4. Pairs of question classes are expanded to pairs of rows, large classes in salted parts.

A shard holds the questions with certain bags of fixed words (all but the rare ones, which may hold a slip), so
a training question meets one shard.  A bag with very many questions is divided by the
rare words' forms; shards that still are too large are cut, and training questions go to each part.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.fmindex import FMIndex
from marginalia.llm.splits import path_key
from marginalia.runtime import Scratch, blocks_for, parallel

CLASSES_PER_SHARD = 20_000
PAIRS_PER_PART = 500_000
#: An ordinary word stands in this many distinct questions at least, at every size of the table.
LEAST_ORDINARY = 3
#: From this many on a word is ordinary even if nothing shows that it's written small, or if it's a German noun; a name never is.
LEAST_COMMON = 20
#: A word is taken for a slip of another if it's this much rarer.
SLIP_RARER = 15
#: Words about which something is known are sent to every task up to this number, and joined to the questions' words beyond it.
SENT_WORDS = 200_000
#: Runs of words in which two questions may agree at most: each moved phrase adds up to three, and an undone slip one.
MOST_SPANS = 7

# Letters of other alphabets that look like Latin ones.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһкмтвнАВЕКМНОРСТХІЈЅοαιρνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhkmtbhABEKMHOPCTXIJSoaipvABEZHIKMNOPTYX")
# Articles, prepositions, conjunctions, auxiliaries and pronouns of the four languages.
_FUNCTION = frozenset(
    """a an the of in on at by for from to with within during across among about as into over under than then that this these those and or is are was were be been do does did has have had it its
    le la les l un une des du de d au aux en dans pour par sur avec et ou est sont que qui t il elle ce cette ces se s
    der die das den dem des ein eine einer einem eines im am vom zum zur bei mit von zu auf unter aus und oder ist sind war waren es
    el los las una unos unas del al con por para y o u e es son fue""".split()
)
# German words that stand before a noun; a name seldom follows them, unless a noun follows it.
_DETERMINERS = frozenset(
    """der die das den dem des ein eine einen einem einer eines welcher welche welches welchen welchem dieser diese dieses diesen diesem jeder jede jedes jeden jedem
    kein keine keinen keinem keiner keines im am vom zum zur beim ins ans""".split()
)
# Words of phrases that lead into a question or end it.
_LEAD = frozenset(
    """hi hello hey so well ok okay now q question quick sorry again ask asking please kindly tell me us you your could can may would will like want need know i we my wonder wondering say let just
    also and but to bitte danke bonjour salut pardon hallo hola gracias thanks thank""".split()
)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,40}>")
_WORD = re.compile(r"[^\W_]+")


def _latin(word: str) -> str:
    """Look-alikes become Latin where a word mixes alphabets or has look-alikes only."""
    if word.isascii():
        return word
    mapped = word.translate(_LOOKALIKE)
    return mapped if mapped == word or all(unicodedata.name(c, "").startswith("LATIN") for c in mapped if c.isalpha()) else word


def read_words(query: str) -> tuple[list[str], list[int]]:
    """The words of a question without case, accents and marks; and for each 1 if written small, 2 if with a capital, 0 if that says nothing."""
    t = query if query.isascii() else unicodedata.normalize("NFKC", query)
    t = _TAG.sub("", t)
    if not t.isascii():
        t = "".join(c for c in t if unicodedata.category(c) != "Cf")
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    raw = [_latin(w) for w in _WORD.findall(t)]
    letters = [w for w in raw if w[0].isalpha()]
    told = sum(w[0].islower() for w in letters) >= 0.4 * len(letters) and not all(w[0].islower() for w in letters)
    case = [0 if i == 0 or not told or not w[0].isalpha() else 1 if w[0].islower() else 2 for i, w in enumerate(raw)]
    return [w.casefold() for w in raw], case


def one_slip(a: str, b: str) -> bool:
    """One letter left out, put in, changed, or two neighbours swapped."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x == y[1:] or x[1:] == y or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


# --- Words ------------------------------------------------------------------------------------

FIXED, RARE = 0, 1


def _forms(word: Column) -> Column:
    """The word itself and the word without each of its letters: words one slip apart have one of them in common."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def _one_slip(a: Column, b: Column) -> Column:
    """:func:`one_slip` as a column, for words that have a form in common."""
    swapped = F.exists(F.sequence(F.lit(1), F.length(a)), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    return (a != b) & ((F.levenshtein(a, b, 1) >= 0) | ((F.length(a) == F.length(b)) & swapped))


def word_facts(words: list[str], case: list[int]) -> dict[str, int]:
    """For each word of one question what its places tell: 1 if written small somewhere, 2 if with a capital inside a sentence, 4 if so as a German noun."""
    facts: dict[str, int] = {}
    for i, (w, c) in enumerate(zip(words, case)):
        noun = c == 2 and i > 0 and words[i - 1] in _DETERMINERS and (i + 1 == len(case) or case[i + 1] != 2)
        facts[w] = facts.get(w, 0) | (c if c < 2 else 6 if noun else 2)
    return facts


def word_counts(tokens: DataFrame) -> DataFrame:
    """For each word the distinct questions that hold it, and those where it's written small, with a capital inside a sentence, or so as a German noun."""
    each = tokens.select(F.explode(F.arrays_zip("own", "facts")).alias("w")).select(F.col("w.own").alias("word"), F.col("w.facts").alias("f"))
    having = lambda bit: F.sum(F.shiftright("f", bit).bitwiseAND(1))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), having(0).alias("small"), having(1).alias("capital"), having(2).alias("noun"))


def lexicon(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """What is known of words: (``word``, ``ordinary``, ``named``, ``meant``, ``meant_name``).

    ``ordinary``: in LEAST_ORDINARY questions and mostly written small, or in LEAST_COMMON and no name, and no frequent slip
    of another.  ``named``: mostly written with a capital inside sentences.  ``meant``: the ordinary word that an unknown word of
    four letters or more without a digit is one slip from; of several one with the same first letter, then the most frequent.
    ``meant_name``: likewise among ordinary words that aren't mostly written small, for words with a capital inside a
    sentence.  Words seen once that no ordinary word is near have no row.
    """
    small = F.col("small") > F.col("capital")
    noun = 2 * F.col("noun") > F.col("capital")
    common = (F.col("n") >= LEAST_COMMON) & ((F.col("capital") <= F.col("small")) | noun)
    no_digit = ~F.col("word").rlike("[0-9]")
    known = scratch.write(counts.where((F.col("n") >= LEAST_ORDINARY) & (small | common) & no_digit).select("word", "n", (~small).alias("capital")), "known")
    # A slip made often enough looks like a word: it is far rarer than the word it's next to.
    frequent = known.select(F.col("word").alias("of"), F.col("n").alias("m"), F.explode(_forms(F.col("word"))).alias("form"))
    slips = known.where(F.length("word") >= 4).select("word", "n", F.explode(_forms(F.col("word"))).alias("form")).join(frequent, "form").where((F.col("m") >= SLIP_RARER * F.col("n")) & _one_slip(F.col("word"), F.col("of")))
    always = counts.sparkSession.createDataFrame([(w, 1, False) for w in sorted(_FUNCTION | _LEAD)], "word string, n bigint, capital boolean")
    ordinary = known.join(slips.select("word").distinct(), "word", "left_anti").unionByName(always).groupBy("word").agg(F.max("n").alias("n"), F.max("capital").alias("capital"))
    ordinary = scratch.write(ordinary, "ordinary")
    near = ordinary.where(F.length("word") >= 3).select(F.col("word").alias("of"), F.col("n").alias("m"), "capital", F.explode(_forms(F.col("word"))).alias("form"))
    unknown = counts.join(ordinary.select("word"), "word", "left_anti")
    forms = unknown.where(no_digit & (F.length("word") >= 4)).select("word", F.explode(_forms(F.col("word"))).alias("form"))
    best = F.struct((F.substring("word", 1, 1) == F.substring("of", 1, 1)).alias("first"), "m", "of")
    meant = forms.join(near, "form").where(_one_slip(F.col("word"), F.col("of"))).groupBy("word").agg(F.max(best)["of"].alias("meant"), F.max(F.when(F.col("capital"), best))["of"].alias("meant_name"))
    named = ((F.col("capital") >= F.col("small")) & (F.col("capital") > 0)).alias("named")
    others = unknown.join(meant, "word", "left").where((F.col("n") > 1) | F.col("meant").isNotNull()).select("word", F.lit(False).alias("ordinary"), named, "meant", "meant_name")
    return scratch.write(others.unionByName(ordinary.select("word", F.lit(True).alias("ordinary"), F.lit(False).alias("named")), allowMissingColumns=True), "lexicon")


Known = tuple[bool, bool, str | None, str | None]


def canonical(words: list[str], case: list[int], known: list[Known | None]) -> tuple[list[str], list[int]]:
    """The content words in reading order, and for each whether it's FIXED or RARE (may hold a slip that is not undone).

    ``known`` gives, for each word, its row of the :func:`lexicon` without the word.
    """
    lead, first = _LEAD | _FUNCTION, 0
    meant = [w if k is None or k[0] or k[2] is None else k[2] for w, k in zip(words, known)]
    while first < len(words) and meant[first] in lead:
        first += 1
    # The first word behind a lead-in has its capital from there.
    for i, (w, c, k) in enumerate(zip(words, case, known)):
        if c == 2 and i > first and k is not None and not k[0]:
            meant[i] = k[3] or w
    last = len(meant)
    while last > first and meant[last - 1] in lead:
        last -= 1
    out, kinds = [], []
    for i in range(first, last):
        w, k = meant[i], known[i]
        if w in _FUNCTION:
            continue
        ordinary = w != words[i] or (k is not None and k[0])
        named = case[i] == 2 if k is None else k[1]
        out.append(w)
        kinds.append(FIXED if ordinary or named or len(w) < 3 or any(c in "0123456789" for c in w) else RARE)
    return out, kinds


_TOKENS = pa.schema([("query", pa.string()), ("words", pa.list_(pa.string())), ("case", pa.list_(pa.int8())), ("own", pa.list_(pa.string())), ("facts", pa.list_(pa.int32()))])
_TOKENS_SQL = "query string, words array<string>, case array<tinyint>, own array<string>, facts array<int>"
_CANON = pa.schema([("query", pa.string()), ("words", pa.list_(pa.string())), ("kinds", pa.list_(pa.int8()))])
_CANON_SQL = "query string, words array<string>, kinds array<tinyint>"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        read = [read_words(q) for q in b["query"].to_pylist()]
        facts = [word_facts(*r) for r in read]
        columns = [[r[0] for r in read], [r[1] for r in read], [list(f) for f in facts], [list(f.values()) for f in facts]]
        yield pa.RecordBatch.from_arrays([b["query"], *(pa.array(c, t) for c, t in zip(columns, _TOKENS.types[1:]))], schema=_TOKENS)


def _canon(sent: Broadcast | None):
    """Canonical words of token rows; what is known of the words comes sent, or with the rows in ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, case = b["words"].to_pylist(), b["case"].to_pylist()
            if sent is not None:
                known = [[sent.value.get(w) for w in ws] for ws in words]
            else:
                known = [[k and tuple(k.values()) for k in ks] for ks in b["known"].to_pylist()]
            found = [canonical(*row) for row in zip(words, case, known)]
            yield pa.RecordBatch.from_arrays([b["query"], pa.array([f[0] for f in found], _CANON.types[1]), pa.array([f[1] for f in found], _CANON.types[2])], schema=_CANON)

    return run


def canonical_rows(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(``query``, ``words``, ``kinds``) of every question with content words; ``words`` is the lexicon."""
    facts = ["ordinary", "named", "meant", "meant_name"]
    if words.count() <= SENT_WORDS:
        sent = tokens.sparkSession.sparkContext.broadcast({r[0]: tuple(r[1:]) for r in words.select("word", *facts).collect()})
        out = tokens.select("query", "words", "case").mapInArrow(_canon(sent), _CANON_SQL)
    else:
        each = tokens.select("query", F.posexplode("words").alias("at", "word"), "case").select("query", "at", "word", F.get("case", F.col("at")).alias("c"))
        each = each.join(words.select("word", F.struct(*facts).alias("known")), "word", "left")
        row = F.array_sort(F.collect_list(F.struct("at", "word", "c", "known")))
        out = each.groupBy("query").agg(row.alias("r")).select("query", F.col("r.word").alias("words"), F.col("r.c").alias("case"), F.col("r.known").alias("known")).mapInArrow(_canon(None), _CANON_SQL)
    return out.where(F.size("words") > 0)


# --- Index and search ---------------------------------------------------------------------------

_INDEX = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("classes", pa.list_(pa.string())), ("bags", pa.list_(pa.int64())), ("kinds", pa.list_(pa.list_(pa.int8()))), ("index", pa.binary())])
_INDEX_SQL = "shard int, part int, classes array<string>, bags array<bigint>, kinds array<array<tinyint>>, index binary"
_MATCHES = pa.schema([("class_c", pa.string()), ("class_e", pa.string()), ("n_spans", pa.int32()), ("word_c", pa.string()), ("word_e", pa.string())])
_MATCHES_SQL = "class_c string, class_e string, n_spans int, word_c string, word_e string"


def _build(table: pa.Table) -> pa.Table:
    """The index of one part of a shard."""
    table = table.sort_by("class")
    row = {"shard": table["shard"][0].as_py(), "part": table["part"][0].as_py(), "classes": table["class"].to_pylist(), "bags": table["bag"].to_pylist(), "kinds": table["kinds"].to_pylist(), "index": FMIndex.build(table["words"].to_pylist()).to_bytes()}
    return pa.Table.from_pylist([row], schema=_INDEX)


def merged_spans(a: list, b: list) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """Maximal matches of two texts, merged so that each place counts once: (place in a, place in b, length), and the places outside them in a and in b."""
    if a == b:
        return [(0, 0, len(a))], [], []
    places: dict = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    free = [True] * len(b)
    spans, outside, i = [], [], 0
    while i < len(a):
        best, at = 0, 0
        for j in places.get(a[i], ()):
            k = 0
            while i + k < len(a) and j + k < len(b) and free[j + k] and a[i + k] == b[j + k]:
                k += 1
            if k > best:
                best, at = k, j
        if best:
            spans.append((i, at, best))
            free[at : at + best] = [False] * best
        else:
            outside.append(i)
        i += max(best, 1)
    return spans, outside, [j for j, f in enumerate(free) if f]


def _seeds(index: FMIndex, patterns: list[list[str]], kinds: list[list[int]]) -> tuple[np.ndarray, ...]:
    """For each pattern the rows of the index that begin with a word it must share: (pattern, low, high).

    That is its rarest fixed word; a pattern of rare words only may lack one of them, so its two rarest count.
    """
    found = []
    for i, (words, kind) in enumerate(zip(patterns, kinds)):
        fixed = {w for w, k in zip(words, kind) if k == FIXED}
        sought = sorted((index.count(w), w) for w in fixed or set(words))[: 1 if fixed else 2]
        found += [(i, *index.rows(w)) for n, w in sought if n]
    return tuple(np.array(c, dtype=np.int64) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 3


def _search(training: pa.Table, indexed: pa.Table) -> pa.Table:
    """Pairs of a training and an evaluation question whose merged spans leave nothing outside, or one rare word each that is one slip from the other."""
    if not training.num_rows or not indexed.num_rows:
        return _MATCHES.empty_table()
    index = FMIndex.from_bytes(indexed["index"][0].as_py())
    classes, bags, kinds_e = indexed["classes"][0].as_py(), np.array(indexed["bags"][0].as_py(), dtype=np.int64), indexed["kinds"][0].as_py()
    own, own_bags = training["class"].to_pylist(), training["bag"].to_numpy()
    patterns, kinds_c = training["words"].to_pylist(), training["kinds"].to_pylist()
    pattern, low, high = _seeds(index, patterns, kinds_c)
    found = []
    for some in np.array_split(np.arange(len(pattern)), max(1, int((high - low).sum()) // 2_000_000)):
        n = high[some] - low[some]
        rows = np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        i, j = np.repeat(pattern[some], n), index.text_of_row[rows].astype(np.int64)
        # Spans can hold all of both texts only where their fixed words make the same bag.
        can = own_bags[i] == bags[j]
        for p, e in {(int(p), int(e)) for p, e in zip(i[can], j[can])}:
            a, b = patterns[p], index.text(e)
            spans, left, right = merged_spans(a, b)
            word_c = word_e = None
            if left or right:
                if len(left) != 1 or len(right) != 1 or len(a) == 1 or kinds_c[p][left[0]] != RARE or kinds_e[e][right[0]] != RARE:
                    continue
                word_c, word_e = a[left[0]], b[right[0]]
                if not one_slip(word_c, word_e):
                    continue
            if len(spans) <= MOST_SPANS:
                found.append((own[p], classes[e], len(spans), word_c, word_e))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _MATCHES.types)], schema=_MATCHES) if found else _MATCHES.empty_table()


class Overlap:
    """The stages of one comparison, each written once to the shared folder.

    ``members``: one row for each label (the one loaded last where a label repeats; among
    equals the same on every run) with its side (``c`` training, ``e`` evaluation), normalised split, source and
    question class.  Labels without a known split or with a null or blank question, or one without
    any content word, have none.
    """

    def __init__(self, labels: DataFrame, *, training: str = "calibration", evaluation: tuple[str, ...] = ("heldout", "golden")):
        spark = labels.sparkSession
        self.scratch = Scratch(spark, "overlap")
        split = F.regexp_replace(F.lower("split"), r"[^\p{L}\p{N}]+", "")
        side = F.when(split == training, "c").when(split.isin(*evaluation), "e")
        rows = labels.where(F.col("label_id").isNotNull()).groupBy("label_id").agg(F.max(F.struct("loaded_at", "query", F.col("split"), "source")).alias("v")).select("label_id", "v.*")
        rows = self.scratch.write(rows.withColumn("side", side).withColumn("split", split).where("side IS NOT NULL AND query IS NOT NULL"), "rows")
        queries = rows.select("query").distinct()
        tokens = self.scratch.write(queries.mapInArrow(_tokens, _TOKENS_SQL).where(F.size("words") > 0), "tokens")
        self.word_counts = self.scratch.write(word_counts(tokens), "counts")
        canon = canonical_rows(tokens, lexicon(self.word_counts, self.scratch)).withColumn("class", F.md5(F.array_join("words", "\u0001")))
        canon = self.scratch.write(canon, "canon")
        self.members = self.scratch.write(rows.join(canon.select("query", "class"), "query").select("label_id", "side", "split", "source", "class"), "members")
        sizes = self.members.groupBy("class").agg(F.count(F.when(F.col("side") == "c", 1)).alias("n_c"), F.count(F.when(F.col("side") == "e", 1)).alias("n_e"))
        words = canon.groupBy("class").agg(F.max(F.struct("words", "kinds")).alias("v")).select("class", "v.*")
        fixed = F.filter(F.arrays_zip("words", "kinds"), lambda x: x["kinds"] == FIXED)
        rare = F.array_sort(F.filter(F.arrays_zip("words", "kinds"), lambda x: x["kinds"] == RARE)["words"])
        bag = F.xxhash64(F.array_join(F.array_sort(fixed["words"]), "\u0001"), F.size("rare"))
        self.classes = self.scratch.write(sizes.join(words, "class").withColumn("rare", rare).withColumn("bag", bag), "classes")
        self.matches = self._match()

    def _match(self) -> DataFrame:
        # Questions with a rare word are searched and indexed on both sides: two slips may meet by way of the word meant.
        indexed, searched = (F.col("n_e") > 0) | (F.size("rare") > 0), (F.col("n_c") > 0) | (F.size("rare") > 0)
        classes = self.classes.select("class", "words", "kinds", "rare", "bag", indexed.alias("indexed"), searched.alias("searched"))
        bags = classes.where("indexed").groupBy("bag").agg(F.count(F.lit(1)).alias("n"))
        # A question goes by its bag; in a bag with very many, once for each form of each of its rare words.
        others = lambda i: F.array_join(F.concat(F.slice("rare", F.lit(1), i), F.slice("rare", i + 2, F.size("rare"))), "\u0001")
        divided = F.array_distinct(F.flatten(F.transform("rare", lambda w, i: F.transform(_forms(w), lambda f: F.xxhash64("bag", others(i), f)))))
        large = (F.coalesce("n", F.lit(0)) > CLASSES_PER_SHARD) & (F.size("rare") > 0)
        ways = classes.join(bags, "bag", "left").withColumn("way", F.explode(F.when(large, divided).otherwise(F.array(F.col("bag"))))).drop("n", "rare")
        ways = self.scratch.write(ways, "ways")
        total = ways.where("indexed").count()
        shards = max(blocks_for(total, CLASSES_PER_SHARD // 4), min(parallel(ways.sparkSession), blocks_for(total, 500)))
        keyed = ways.withColumn("shard", F.pmod(F.xxhash64("way"), F.lit(shards)).cast("int")).drop("way").distinct()
        # Parts of each shard, by the number of questions: one row a shard.
        parts = keyed.groupBy("shard").agg(
            F.ceil(F.count(F.when(F.col("indexed"), 1)) / CLASSES_PER_SHARD).cast("int").alias("parts"), F.ceil(F.count(F.when(F.col("searched"), 1)) / (4 * CLASSES_PER_SHARD)).cast("int").alias("streams")
        )
        keyed = keyed.join(parts.where("parts > 0"), "shard")  # their number grows with the data: no hint
        own = F.xxhash64("class", F.lit("part"))
        evaluation = keyed.where("indexed").select("shard", F.pmod(own, F.col("parts")).cast("int").alias("part"), "class", "bag", "words", "kinds")
        index = self.scratch.write(evaluation.groupBy("shard", "part").applyInArrow(_build, _INDEX_SQL), "index")
        training = keyed.where("searched AND streams > 0").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(own, F.col("streams")).cast("int").alias("stream"), "class", "bag", "words", "kinds")
        streams = index.join(parts.select("shard", "streams"), "shard").where("streams > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("stream")).drop("streams")
        keys = ["shard", "part", "stream"]
        found = self.scratch.write(training.groupBy(*keys).cogroup(streams.groupBy(*keys)).applyInArrow(_search, _MATCHES_SQL), "found")
        sizes = self.classes.select("class", "n_c", "n_e")
        same = found.where("word_c IS NULL").drop("word_c", "word_e")
        same = same.join(sizes.select(F.col("class").alias("class_c"), "n_c"), "class_c").join(sizes.select(F.col("class").alias("class_e"), "n_e"), "class_e").where("n_c > 0 AND n_e > 0")
        pairs = same.select("class_c", "class_e", "n_spans").unionByName(self._rare_slips(found.where("word_c IS NOT NULL").distinct()))
        return self.scratch.write(pairs.groupBy("class_c", "class_e").agg(F.min("n_spans").alias("n_spans")), "matches")

    def _rare_slips(self, found: DataFrame) -> DataFrame:
        """Of the pairs with one word outside on each side, those where it is a slip.

        One of the two must be seen written small.  Two words that both stand in several
        contexts, neither SLIP_RARER times as many as the other's, are different words.  Two slips in the same word pair by way of that word.
        """
        words = found.select(F.col("word_c").alias("word")).union(found.select("word_e")).distinct()
        at = self.classes.where(F.size("rare") > 0).select("bag", "rare", F.explode(F.array_distinct("rare")).alias("word")).join(words, "word")
        others = F.filter("rare", lambda w: w != F.col("word"))
        contexts = at.groupBy("word").agg(F.countDistinct("bag", F.array_join(others, "\u0001")).alias("n"))
        contexts = contexts.join(self.word_counts.select("word", (F.col("small") > 0).alias("small")), "word")
        sizes = self.classes.select("class", "n_c", "n_e")
        sides = found
        for side, name in (("c", "w"), ("e", "v")):
            facts = contexts.select(F.col("word").alias(f"word_{side}"), "n", "small")
            sides = sides.join(facts, f"word_{side}").join(sizes.withColumnRenamed("class", f"class_{side}"), f"class_{side}")
            sides = sides.withColumn(name, F.struct("n", F.col(f"word_{side}").alias("word"), F.col(f"class_{side}").alias("class"), "n_c", "n_e", "small")).drop("n", "small", "n_c", "n_e")
        few = F.least("w.n", "v.n") <= F.greatest(F.lit(1), F.greatest("w.n", "v.n") / SLIP_RARER)
        longer = F.greatest(F.length("w.word"), F.length("v.word")) >= 4
        edges = self.scratch.write(sides.where((F.col("w.small") | F.col("v.small")) & few & longer).select("w", "v", "n_spans").distinct(), "rare_slips")
        # The word a slip was meant to be: the one in more contexts, or else the later.
        meant = edges.where("w < v").groupBy("w").agg(F.max("v").alias("v"), F.max("n_spans").alias("n_spans"))
        twice = meant.join(meant.select(F.col("w").alias("u"), "v"), "v").where("w.class <> u.class").select("w", F.col("u").alias("v"), "n_spans")
        return edges.unionByName(twice).where("w.n_c > 0 AND v.n_e > 0").select(F.col("w.class").alias("class_c"), F.col("v.class").alias("class_e"), "n_spans")

    def pairs(self) -> DataFrame:
        """(``label_id_a``, ``label_id_b``), the smaller first: every training and evaluation row that ask the same."""
        sizes = self.classes.select("class", "n_c", "n_e")
        both = self.matches.select("class_c", "class_e")
        counted = both.join(sizes.select(F.col("class").alias("class_c"), "n_c"), "class_c").join(sizes.select(F.col("class").alias("class_e"), "n_e"), "class_e")
        salted = counted.withColumn("parts", F.least(F.ceil(F.col("n_c") * F.col("n_e") / PAIRS_PER_PART), F.col("n_c")).cast("int"))
        c = self.members.where("side = 'c'").select(F.col("class").alias("class_c"), F.col("label_id").alias("c"))
        e = self.members.where("side = 'e'").select(F.col("class").alias("class_e"), F.col("label_id").alias("e"))
        left = salted.join(c, "class_c").select("class_c", "class_e", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part"), "c")
        right = salted.join(e, "class_e").select("class_c", "class_e", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "e")
        out = left.join(right, ["class_c", "class_e", "part"])
        return out.select(F.least("c", "e").alias("label_id_a"), F.greatest("c", "e").alias("label_id_b"))

    def counts(self) -> DataFrame:
        """For each evaluation split and source: rows, rows with a training row that asks the same, and pairs; no pair is built."""
        sizes = self.classes.select(F.col("class").alias("class_c"), "n_c")
        asked = self.matches.join(sizes, "class_c").groupBy(F.col("class_e").alias("class")).agg(F.sum("n_c").alias("n"))
        rows = self.members.where("side = 'e'").join(asked, "class", "left")
        return rows.groupBy("split", path_key(F.col("source")).alias("source")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs")
        )

    def spans(self) -> DataFrame:
        """Pairs of rows by the number of merged spans that hold them: 1 where all words stand in the same order, more for moved phrases and slips."""
        sizes = self.classes.select("class", "n_c", "n_e")
        each = self.matches.join(sizes.select(F.col("class").alias("class_c"), "n_c"), "class_c").join(sizes.select(F.col("class").alias("class_e"), "n_e"), "class_e")
        return each.groupBy("n_spans").agg(F.sum(F.col("n_c") * F.col("n_e")).alias("n_pairs"), F.count(F.lit(1)).alias("n_classes"))
