"""Spelling variants: words one edit apart, grouped under their frequent form.

Words of all texts are counted first. Two near words share all but one place.
Call m the length of the shorter and i the length of their common beginning
(at most m - 1): if i >= m / 2 they agree in the first half, else in the
second. So each word goes to four groups: by the half it would share with
words of its length or longer, and with shorter ones, from either side.
Groups of more than `most` words are cut at half of the rest in which the
error lies, again and again; a group where one place is left holds as many
words as the alphabet allows at most. No pair is looked at outside a group,
and each pair belongs to one group.

Within a task, groups come sorted and in bounded chunks. The words of a chunk
that share a beginning form a minimal acyclic automaton, those that share an
end one of the reversed words; each path adds up to the word's number (a
perfect hash), which is its place in the list of counts. A word walks its shared half
exactly and completes the other with one error, and what is found is told
apart by i, so no pair counts twice.

Null text has no words; a null doc_id counts as the empty string. Repeated
rows count as often as they occur. Empty tables give no rows. Ties between
forms go to the smallest word in code-point order. Other columns are ignored,
whatever their names. Words may be of any length; an automaton holds about as
many states as its words have characters.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, staged, text_of

RUN = "[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5
DIVISOR = 199
#: Words of a group before it is cut, and characters of the words in an automaton (one group at least).
MOST = 20_000
CHUNK = 200_000


def lowered(run: Column) -> Column:
    """A-Z in lower case, other capitals as they are."""
    return F.when(run.rlike("[À-Þ]"), F.translate(run, UPPER, UPPER.lower())).otherwise(F.lower(run))


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of all words that are long and frequent enough. A run whose
    checksum with its document's id divides by 199 loses the code point that the checksum names."""
    runs = docs.select(F.coalesce(docs[doc_id].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(docs, text), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", lowered(F.col("run")).alias("run")).where(F.char_length("run") >= least_length)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.expr("cast(h % char_length(run) as int)")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + F.lit(2), F.char_length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DIVISOR == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def with_group(rows: DataFrame) -> DataFrame:
    """Add `g`: a number for the beginning up to `lo` and the end from `hi` on that the group's words share."""
    shared = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.expr("right(word, m - hi)"))
    return rows.withColumn("g", F.xxhash64("m", "lo", "hi", shared))


def halved(rows: DataFrame) -> DataFrame:
    """Each row twice: the error in the second half of lo..hi, and in the first."""
    mid = F.expr("lo + (hi - lo) div 2").cast("int")
    both = F.array(F.struct(mid.alias("lo"), F.col("hi")), F.struct(F.col("lo"), mid.alias("hi")))
    return with_group(rows.select("word", "n", "m", F.inline(both)))


def groups(words: DataFrame, most: int = MOST, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Rows of word, n, m, lo, hi and g, so that each pair of near words meets in one g."""
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= least_length)
    done, rows = None, staged(halved(rows.select("word", "n", "m", F.lit(0).alias("lo"), F.col("m").alias("hi"))), "groups")
    while True:
        full = rows.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > most).select("g")
        if full.isEmpty():
            return rows if done is None else done.unionByName(rows)
        open_ = F.col("hi") - F.col("lo") > 1
        marked = staged(rows.join(full.withColumn("full", F.lit(True)), "g", "left").withColumn("full", F.col("full").isNotNull() & open_), "groups")
        cold = marked.where("not full").select(rows.columns)
        done = cold if done is None else done.unionByName(cold)
        rows = staged(halved(marked.where("full")), "groups")


class Automaton:
    """Minimal acyclic automaton of sorted distinct words. steps[state][char]
    is (state, words passed over); the sum over a path is the word's number."""

    def __init__(self, words: list[str]):
        self.steps, self.final = [{}], [False]
        known, path, last = {}, [0], ""

        def settle(down_to: int) -> None:
            while len(path) > down_to + 1:
                state, char = path.pop(), last[len(path) - 1]
                shape = (self.final[state], *self.steps[state].items())
                if (same := known.setdefault(shape, state)) != state:
                    self.steps[path[-1]][char] = same
                    if state == len(self.steps) - 1:
                        for of in (self.steps, self.final):
                            of.pop()

        for word in words:
            shared = 0
            while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
                shared += 1
            settle(shared)
            for char in word[shared:]:
                self.steps[path[-1]][char] = len(self.steps)
                path.append(len(self.steps))
                self.steps.append({})
                self.final.append(False)
            self.final[path[-1]] = True
            last = word
        settle(0)
        self._number()

    def _number(self) -> None:
        below: list[int | None] = [None] * len(self.steps)
        stack = [0]
        while stack:
            state = stack[-1]
            if below[state] is not None:
                stack.pop()
            elif rest := [t for t in self.steps[state].values() if below[t] is None]:
                stack += rest
            else:
                sums = list(accumulate((below[t] for t in self.steps[state].values()), initial=int(self.final[state])))
                below[state] = sums[-1]
                self.steps[state] = {c: (t, s) for (c, t), s in zip(self.steps[state].items(), sums)}

    def number(self, word: str, state: int = 0, start: int = 0) -> int:
        """The number of a word, or what is left of it from a state on; -1 if it is not there."""
        total, steps = 0, self.steps
        for char in word[start:] if start else word:
            step = steps[state].get(char)
            if step is None:
                return -1
            state = step[0]
            total += step[1]
        return total if self.final[state] else -1

    def near(self, word: str, exact: int, shorter: bool) -> list[int]:
        """Numbers of the words that share `exact` characters and differ by one
        edit after: with one fewer if `shorter`, else with as many or one more."""
        state, total, out, steps, size = 0, 0, [], self.steps, len(word)
        for char in word[:exact]:
            step = steps[state].get(char)
            if step is None:
                return out
            state = step[0]
            total += step[1]
        for i in range(exact, size + 1):
            here = word[i] if i < size else ""
            if shorter:
                if here and (i + 1 == size or word[i + 1] != here) and (k := self.number(word, state, i + 1)) >= 0:
                    out.append(total + k)
            else:
                rest, after, wanted = word[i:], word[i + 1 :], word[i + 1 : i + 2]
                for char, (t, passed) in steps[state].items():
                    if char != here:
                        ahead = steps[t]
                        if (here in ahead or not here) and (k := self.number(rest, t)) >= 0:
                            out.append(total + passed + k)
                        if here and (wanted in ahead or not wanted) and (k := self.number(after, t)) >= 0:
                            out.append(total + passed + k)
            if not here or (step := steps[state].get(here)) is None:
                break
            state = step[0]
            total += step[1]
        return out


def common(a: str, b: str) -> int:
    i = 0
    for x, y in zip(a, b):
        if x != y:
            break
        i += 1
    return i


def matches(rows: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, str]]:
    """rows: word, n, m, lo, hi of whole groups. Gives word, near words found, the largest n among them and its smallest word."""
    out = []
    for back in (False, True):
        side = [r for r in rows if (r[2] - r[4] > r[3]) == back]
        counts = {(w[::-1] if back else w): n for w, n, *_ in side}
        words = sorted(counts)
        auto, n_of = Automaton(words), [counts[w] for w in words]
        for word, _, m, lo, hi in side:
            found = auto.near(word[::-1], m - hi, len(word) > m) if back else auto.near(word, lo, len(word) > m)
            best, k = (0, ""), 0
            for number in found:
                other = words[number][::-1] if back else words[number]
                if lo <= min(common(word, other), m - 1) < hi:
                    k += 1
                    best = min(best, (-n_of[number], other))
            if k:
                out.append((word, k, -best[0], best[1]))
    return out


def near_words(grouped: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """word, n_near, best_n and best of each group that has any."""

    def search(batches):
        held, size, group = [], 0, None
        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group and size >= chunk:
                    yield found(held)
                    held, size = [], 0
                held.append(tuple(row))
                size += len(row[0])
                group = g
        yield found(held)

    def found(held):
        columns = list(zip(*matches(held))) or [[]] * 4
        kinds = (("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[k for k, _ in kinds])

    rows = grouped.select("g", "word", "n", "m", "lo", "hi").repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(search, "word string, n_near long, best_n long, best string")


def rooted(forms: DataFrame) -> DataFrame:
    """word and root of words that have a form, by doubling the steps taken."""
    roots = staged(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not roots.where("moved").isEmpty():
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = staged(roots.join(beyond, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
    return roots.drop("moved")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """One row per word: n, n_near, form, form_n and root."""
    ready(docs.sparkSession, 10_000)
    words = staged(word_counts(docs, doc_id, text), "words")
    found = near_words(groups(words, most), chunk)
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    rows = rows.unionByName(found.withColumn("n", F.lit(0).cast("long"))).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("low"), "best"))).alias("best")
    )
    is_form = -F.col("best.low") >= F.col("n") * TIMES
    rows = staged(rows.select("word", "n", "n_near", F.when(is_form, F.col("best.best")).alias("form"), F.when(is_form, -F.col("best.low")).alias("form_n")), "near")
    roots = rooted(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
