"""Spelling variant grouping: words one edit apart, the much more frequent one as the form of the other.

Two words that differ by one edit share the first or the last half of the shorter one, so words meet in groups by half and
length; a group of more than ``MOST`` words is split again by the half of what its words do not share yet, until it is small
or a single letter is left. Inside a group the sorted words are searched by dynamic programming: the rows of the edit matrix
(three cells wide, as only one edit is allowed) belong to prefixes, so neighbours in the list share those of their longest
common prefix, and a range of the list whose shared prefix already costs more than one edit is left out whole. All words of
a block advance through the list together, one letter of depth at a time. Each pair is counted in one of its groups only.

Defined results: NULL and empty texts have no words; a NULL id counts as empty text where ids matter. Words of any length are
compared whole. Equal counts go to the smaller word in code-point order. Extra columns are not read. An empty table gives an
empty vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import materialize

#: The letters of words, and those that are lower-cased.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MOST = 1 << 16
TOGETHER = 1 << 14
BLOCK = 2048


def runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, once per maximal run of letters of it, as ``run`` with A-Z lower-cased."""
    found = F.explode(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(LETTERS), F.lit(0)))
    return docs.select(*[c for c in docs.columns if c not in (text, "run")], found.alias("run"))


def slipped(run: Column, key: Column, one_in: int) -> Column:
    """Planted slips: a run loses one letter where ``one_in`` divides the checksum of key and run, which also picks the letter."""
    told = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run)
    check = F.crc32(told.cast("binary"))
    at = (check % F.char_length(run)).cast("int")
    shorter = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))
    return F.when(check % one_in == 0, shorter).otherwise(run)


def vocabulary(words: DataFrame, column: str = "word", least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): distinct words of at least that many code points and occurrences, combined in each task first."""
    long_enough = words.where(F.char_length(column) >= least_length).groupBy(F.col(column).alias("word"))
    return long_enough.agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


_GROUP = "struct<low:int,head:int,tail:int,but:int>"


def _halves() -> Column:
    """The two groups by which a pair of group ``g`` can be found: by half of its unshared letters more in front or behind.

    ``but``: pairs that share that many first letters are found in another group.
    """
    more = ((F.col("g.low") - F.col("g.head") - F.col("g.tail")) / 2).cast("int")
    front = F.struct(F.col("g.low").alias("low"), (F.col("g.head") + more).alias("head"), F.col("g.tail").alias("tail"), F.col("g.but").alias("but"))
    behind = F.struct(
        F.col("g.low").alias("low"), F.col("g.head").alias("head"), (F.col("g.tail") + more).alias("tail"),
        F.least(F.col("g.but"), F.col("g.head") + more).alias("but"),
    )
    return F.explode(F.array(front.cast(_GROUP), behind.cast(_GROUP)))


def _with_key(rows: DataFrame) -> DataFrame:
    ends = F.substring("word", 1, F.col("g.head")), F.substring("word", F.char_length("word") - F.col("g.tail") + 1, F.col("g.tail"))
    return rows.withColumn("key", F.xxhash64("g.low", "g.head", "g.tail", "g.but", *ends))


def groups(words: DataFrame, least_length: int = 5, most: int = MOST) -> DataFrame:
    """(word, n, g, key): each word in every group in which it may find a near word; none has more than ``most`` words
    unless they differ in a single place."""
    size = F.char_length("word")
    lows = F.filter(F.array(size, size - 1), lambda low: low >= least_length)
    whole = F.transform(lows, lambda low: F.struct(low.alias("low"), F.lit(0).alias("head"), F.lit(0).alias("tail"), low.alias("but")).cast(_GROUP))
    rows = words.select("word", "n", F.explode(whole).alias("g"))
    open_ = _with_key(rows.select("word", "n", _halves().alias("g")))
    done = None
    while True:
        open_ = materialize(open_, "word-groups")
        splittable = F.col("g.low") - F.col("g.head") - F.col("g.tail") > 1
        crowded = open_.where(splittable).groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
        crowded = materialize(crowded.select("_key"), "crowded")
        if not crowded.limit(1).count():
            return open_ if done is None else done.unionByName(open_)
        small = open_.join(crowded, F.col("key") == F.col("_key"), "left_anti")
        done = small if done is None else done.unionByName(small)
        large = open_.join(crowded, F.col("key") == F.col("_key"), "left_semi")
        open_ = _with_key(large.select("word", "n", _halves().alias("g")))


class SortedWords:
    """Sorted words of consecutive groups with the common prefixes of neighbours (-1 where a group begins)."""

    def __init__(self, words: list[str], group: np.ndarray):
        self.count = len(words)
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        begins = np.ones(self.count, bool)
        begins[1:] = group[1:] != group[:-1]
        first = np.flatnonzero(begins)
        self.low = np.repeat(first, np.diff([*first, self.count]))
        self.high = np.repeat([*first[1:], self.count], np.diff([*first, self.count]))
        self.shared = np.where(begins, -1, 0)
        alive, depth = np.flatnonzero(~begins), 0
        while len(alive):
            alive = alive[np.minimum(self.lengths[alive], self.lengths[alive - 1]) > depth]
            alive = alive[self.codes[self.starts[alive] + depth] == self.codes[self.starts[alive - 1] + depth]]
            depth += 1
            self.shared[alive] = depth
        self.by_shared = np.argsort(self.shared, kind="stable")
        self.sorted_shared = self.shared[self.by_shared]

    def _forks(self, depth: int) -> np.ndarray:
        """Places of the list at which words part after exactly ``depth`` common letters."""
        lo, hi = np.searchsorted(self.sorted_shared, [depth, depth + 1])
        return self.by_shared[lo:hi]

    def _differs(self, word: np.ndarray, place: int, letter: np.ndarray) -> np.ndarray:
        """1 where the letter at ``place`` of a word is another (or none), else 0."""
        there = (place >= 0) & (place < self.lengths[word])
        spot = np.where(there, self.starts[word] + place, 0)
        return np.where(there, self.codes[spot] != letter, True).astype(np.int8)

    def one_edit(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, other): all words of the same group at exactly one edit from each of ``word``."""
        lo, hi = self.low[word].copy(), self.high[word].copy()
        size = self.lengths[word]
        before, at = np.full(len(word), 2, np.int8), np.zeros(len(word), np.int8)
        after = np.where(size >= 1, 1, 2).astype(np.int8)
        found, depth = [], 0
        while len(word):
            while True:
                ended = np.flatnonzero((lo < hi) & (self.lengths[np.minimum(lo, self.count - 1)] == depth))
                if not len(ended):
                    break
                size = self.lengths[word[ended]] - depth
                edits = np.select([size == -1, size == 0, size == 1], [before[ended], at[ended], after[ended]], 2)
                near = ended[edits == 1]
                found.append((word[near], lo[near]))
                lo[ended] += 1
            forks = self._forks(depth)
            left, right = np.searchsorted(forks, lo, "right"), np.searchsorted(forks, hi, "left")
            parts = np.where(lo < hi, np.maximum(right - left, 0) + 1, 0)
            row = np.repeat(np.arange(len(word)), parts)
            begin = np.cumsum(parts) - parts
            into = np.arange(len(row)) - begin[row]
            child_lo = np.where(into == 0, lo[row], forks[np.minimum(left[row] + into - 1, len(forks) - 1)] if len(forks) else lo[row])
            last = into == parts[row] - 1
            child_hi = np.where(last, hi[row], forks[np.minimum(left[row] + into, len(forks) - 1)] if len(forks) else hi[row])
            word, letter = word[row], self.codes[self.starts[child_lo] + depth] if len(row) else np.zeros(0, np.uint32)
            size = self.lengths[word]
            a, b, c = before[row], at[row], after[row]
            before = np.minimum(a + self._differs(word, depth - 1, letter), b + 1)
            at = np.minimum(np.minimum(b + self._differs(word, depth, letter), c + 1), before + 1)
            at = np.where(size > depth, at, 2)
            after = np.where(size > depth + 1, np.minimum(c + self._differs(word, depth + 1, letter), at + 1), 2)
            before = np.where((size >= depth) & (depth > 0), before, np.where(depth == 0, 1, 2))
            live = np.minimum(np.minimum(before, at), after) <= 1
            word, lo, hi = word[live], child_lo[live], child_hi[live]
            before, at, after = (np.minimum(x[live], 2).astype(np.int8) for x in (before, at, after))
            depth += 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_FOUND = "word string, n_near bigint, form_n bigint, form string"


def _search(table: pa.Table) -> pa.RecordBatch:
    """Per word of whole groups: how many near words it has there, and the best of them."""
    turned = table.column("turned").to_pylist()
    flipped = table.column("flipped").to_pylist()
    words = [t[::-1] if f else t for t, f in zip(turned, flipped, strict=True)]
    low, but, n = (table.column(c).to_numpy() for c in ("low", "but", "n"))
    listed = SortedWords(turned, table.column("key").to_numpy())
    fronts: dict[str, int] = {}
    front = np.array([fronts.setdefault(w[:b], len(fronts)) for w, b in zip(words, but.tolist(), strict=True)], np.int64)
    alike = np.zeros(len(words), np.int64)
    alike[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    counts, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    many = np.flatnonzero(listed.high - listed.low > 1)
    for at in range(0, len(many), BLOCK):
        word, other = listed.one_edit(many[at : at + BLOCK])
        here = np.minimum(listed.lengths[word], listed.lengths[other]) == low[word]
        here &= (front[word] != front[other]) | (but[word] >= low[word])
        word, other = word[here], other[here]
        counts += np.bincount(word, minlength=len(words))
        order = np.lexsort((alike[other], -n[other], word))
        word, other = word[order], other[order]
        first = np.ones(len(word), bool)
        first[1:] = word[1:] != word[:-1]
        best[word[first]] = other[first]
    rows = np.flatnonzero(counts).tolist()
    return pa.RecordBatch.from_pydict({
        "word": pa.array([words[r] for r in rows], pa.string()), "n_near": pa.array(counts[rows], pa.int64()),
        "form_n": pa.array(n[best[rows]], pa.int64()), "form": pa.array([words[best[r]] for r in rows], pa.string()),
    })


def near_words(words: DataFrame, least_length: int = 5, most: int = MOST) -> DataFrame:
    """(word, n_near, form_n, form) of the distinct ``words`` with near ones: their number and the most frequent."""
    flipped = F.col("g.tail") > F.col("g.head")
    turned = F.when(flipped, F.reverse("word")).otherwise(F.col("word"))
    rows = groups(words, least_length, most).select(
        "key", turned.alias("turned"), flipped.alias("flipped"), "n", F.col("g.low").alias("low"), F.col("g.but").alias("but")
    )

    def run(batches):
        waiting: list[pa.Table] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(pa.Table.from_batches([batch]))
            held += batch.num_rows
            if held < TOGETHER:
                continue
            table = pa.concat_tables(waiting)
            keys = table.column("key").to_numpy()
            whole = int(np.flatnonzero(keys != keys[-1]).max(initial=-1)) + 1
            if whole:
                yield _search(table.slice(0, whole).combine_chunks())
            waiting, held = [table.slice(whole)], len(keys) - whole
        if held:
            yield _search(pa.concat_tables(waiting).combine_chunks())

    each = rows.repartition("key").sortWithinPartitions("key", "turned").mapInArrow(run, _FOUND)
    top = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", (-F.col("top.less")).alias("form_n"), F.col("top.form").alias("form")
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """Add ``root``: the last word reached by following ``form``, in steps that double (forms grow in frequency, so no circle)."""
    known = materialize(forms.where("form IS NOT NULL").select(F.col("word").alias("_w"), F.col("form").alias("_r")), "roots")
    while True:
        further = known.select(F.col("_w").alias("_from"), F.col("_r").alias("_to"))
        jumped = known.join(further, F.col("_r") == F.col("_from"), "left")
        known = materialize(jumped.select("_w", F.coalesce("_to", "_r").alias("_r"), F.col("_to").isNotNull().alias("_more")), "roots")
        if not known.where("_more").limit(1).count():
            break
        known = known.drop("_more")
    found = known.select("_w", "_r")
    return forms.join(found, F.col("word") == F.col("_w"), "left").select(*forms.columns, F.coalesce("_r", "word").alias("root"))


def group_variants(words: DataFrame, least_length: int = 5, ratio: int = 2, most: int = MOST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct ``words`` (word, n): the form is the most frequent near word if it
    is at least ``ratio`` times as frequent."""
    words = materialize(words.select("word", "n"), "vocabulary")
    near = near_words(words, least_length, most).select(F.col("word").alias("_word"), "n_near", F.col("form").alias("_form"), F.col("form_n").alias("_form_n"))
    taken = F.col("_form_n") >= ratio * F.col("n")
    joined = words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("_form")).alias("form"), F.when(taken, F.col("_form_n")).alias("form_n"),
    )
    return with_roots(materialize(joined, "forms"))
