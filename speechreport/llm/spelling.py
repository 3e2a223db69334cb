"""Spelling variants: words that differ by one edit, found by dense comparison of blocks of words.

Two words differ by one inserted, deleted or replaced code point if their common prefix and common suffix
together reach the longer length minus one. Blocks of words become matrices of code points, padded to one
width, once from the left and once from the right; a pair of blocks is compared column by column for the lengths of
all common prefixes and suffixes at once.

Which blocks meet: of two such words whose longer one has m code points, the first m // 2 are equal or the last
m - m // 2. So each word stands in the groups of its first and of its last half, for its own length as the longer one's and
for the next one, and blocks are cut from the rows in order of groups. A group with more than CELLS code points is
split in the same way: what is still open between the shared prefix and suffix has its first or its second half in
common as well. With one open code point there are no more words than letters, so no group stays large, whatever share
of the words it had, and none is dealt to one task whole. Each pair is accepted in one group only, by the length of
its common prefix.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechreport.llm.common import dropped, materialize

#: Code points of a word at least, occurrences at least, and how many times as frequent a form is as its variants.
LENGTH, OCCURRENCES, TIMES = 7, 2, 10
#: A run whose hash is a multiple of this loses a code point.
TYPO = 31
#: Distinct words that a task counts at a time.
COUNTED = 300_000
#: Code points of a group that is not split, rows of a block, and cells of its matrix.
CELLS, BLOCK, MATRIX = 1 << 15, 128, 1 << 22


def counted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(word, n) of the runs of letters that are long enough, as partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LENGTH).findall
        total: Counter = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for own, raw in zip(batch.column(0), batch.column(1), strict=True):
                begun = zlib.crc32(f"{own.as_py() if own.is_valid else ''}:".encode())
                # bytes.lower() changes A-Z alone
                for word, n in Counter(runs((raw.as_py() or b"").lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % TYPO == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LENGTH:
                            continue
                    total[word] += n
                if len(total) >= COUNTED:
                    yield given()
                    total.clear()
        if total:
            yield given()

    return df.select(key, F.col(text).cast("binary")).mapInArrow(run, "word string, n long")


def halves(rows: DataFrame) -> DataFrame:
    """Each row (word, n, m, p, s, hi) in the two groups that share half of what is open between p and s.

    p, s: code points of the shared prefix and suffix; a pair belongs to the group if its common prefix is in [p, hi).
    """
    cut = F.col("p") + ((F.col("m") - F.col("p") - F.col("s")) / 2).cast("int")
    first = F.struct(cut.alias("p"), F.col("s"), F.col("hi"))
    second = F.struct(F.col("p"), (F.col("m") - cut).alias("s"), F.least("hi", cut).alias("hi"))
    return rows.select("word", "n", "m", F.inline(F.array(first, second)))


def group_id() -> Column:
    return F.xxhash64("m", "p", "s", F.left("word", F.col("p")), F.right("word", F.col("s")))


def placed(vocabulary: DataFrame) -> DataFrame:
    """Rows (g, word, n, m, p, s, hi) of all groups that hold a word of length m and another one."""
    longest = F.array(F.length("word"), F.length("word") + 1)
    open_ = halves(vocabulary.select("word", "n", F.explode(longest).alias("m")).withColumns({"p": F.lit(0), "s": F.lit(0), "hi": F.col("m")}))
    done: DataFrame | None = None
    while True:
        rows = materialize(open_.withColumn("g", group_id()))
        sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("m").cast("long")).alias("width"), F.max((F.length("word") == F.col("m")).cast("int")).alias("whole"), F.max(F.col("m") - F.col("p") - F.col("s")).alias("free"))
        sizes = sizes.filter("size > 1 and whole = 1")
        large = (F.col("size") * F.col("width") > CELLS) & (F.col("free") > 1)
        sizes = materialize(sizes.select("g", large.alias("large")))
        rows = rows.join(sizes, "g")
        small = rows.filter(~F.col("large")).drop("large")
        done = small if done is None else done.unionByName(small)
        if sizes.filter("large").isEmpty():
            return done
        open_ = halves(rows.filter("large").drop("large", "g"))


def matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Columns of code points of the words, and of the words from their ends, padded with 0."""
    width = max(map(len, words))
    told = (np.array(ws, f"U{width}").view(np.uint32).reshape(len(words), width) for ws in (words, [w[::-1] for w in words]))
    return tuple(np.ascontiguousarray(x.T.astype(np.uint8)) for x in told)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal code points from the start, for all pairs of columns of two matrices; padding counts as a code point."""
    alive = np.ones((a.shape[1], b.shape[1]), bool)
    found = np.zeros(alive.shape, np.uint8 if len(a) < 256 else np.int32)
    for x, y in zip(a, b, strict=False):
        alive &= x[:, None] == y[None, :]
        if not alive.any():
            break
        found += alive
    return found


def near(words: list[str], group: np.ndarray, m: np.ndarray, p: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of words of one group that differ by one edit; rows are in order of groups."""
    width = int(m.max())
    step = max(2, min(BLOCK, MATRIX // width))
    blocks = [slice(k, min(k + step, len(words))) for k in range(0, len(words), step)]
    tables = [matrix(words[b]) for b in blocks] if len(words) * width <= MATRIX else None
    size = np.array([len(w) for w in words], np.int32)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k, x in enumerate(blocks):
        left = tables[k] if tables else matrix(words[x])
        for j in range(k, len(blocks)):
            y = blocks[j]
            if group[y.start] != group[x.stop - 1] and j > k:
                break
            right = left if j == k else tables[j] if tables else matrix(words[y])
            least = np.minimum(size[x][:, None], size[y][None, :])
            head, tail = (np.minimum(common(a, b), least).astype(np.int32) for a, b in zip(left, right, strict=True))
            longer = np.maximum(size[x][:, None], size[y][None, :])
            same = (group[x][:, None] == group[y][None, :]) & (longer == m[x][:, None]) & (m[x][:, None] == m[y][None, :]) & (longer - least <= 1)
            fits = same & (head + tail >= longer - 1) & (head >= p[x][:, None]) & (head < hi[x][:, None])
            if j == k:
                fits &= np.tri(*fits.shape, -1, dtype=bool).T
            at = np.nonzero(fits)
            found.append((at[0] + x.start, at[1] + y.start))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def compared(rows: DataFrame) -> DataFrame:
    """(word, n_near, best: -n and word of the most frequent near word) of each word in each run of groups that has a near word."""
    names = ["word", "n_near", "best"]
    best = pa.struct([("order", pa.int64()), ("word", pa.string())])

    def pairs(table: pa.Table) -> pa.RecordBatch:
        words = table["word"].to_pylist()
        n, *rest = (table[c].to_numpy() for c in ("n", "g", "m", "p", "hi"))
        i, j = near(words, *rest)
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[b], -n[b], a))
        a, b = a[order], b[order]
        own, first, count = np.unique(a, return_index=True, return_counts=True)
        top = b[first]
        told = pa.StructArray.from_arrays([pa.array(-n[top], pa.int64()), pa.array([words[k] for k in top.tolist()], pa.string())], fields=list(best))
        return pa.RecordBatch.from_arrays([pa.array([words[k] for k in own.tolist()], pa.string()), pa.array(count, pa.int64()), told], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*rest, batch]).combine_chunks()
            group, width = table["g"].to_numpy(), table["m"].to_numpy()
            # whole groups of one width are put together until they fill a block; the last ones may go on in the next batch
            starts = np.nonzero(np.diff(group, prepend=group[0] ^ 1))[0]
            wide = np.nonzero(np.diff(width, append=-1))[0] + 1
            begin = 0
            while True:
                end = min(int(np.append(starts, len(group))[np.searchsorted(starts, begin + BLOCK)]), int(wide[np.searchsorted(wide, begin, "right")]))
                if end == len(group):
                    break
                yield pairs(table.slice(begin, end - begin))
                begin = end
            rest = table.slice(begin).to_batches()
        if rest:
            yield pairs(pa.Table.from_batches(rest))

    dealt = rows.select("g", "word", "n", "m", "p", "hi").repartition("g").sortWithinPartitions("m", "g")
    return dealt.mapInArrow(run, "word string, n_near long, best struct<order: long, word: string>")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms are followed to the last one, twice as far in each round."""
    roots = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        found = materialize(roots.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        dropped(roots)
        if found.filter("moved").isEmpty():
            return found.select("word", "root")
        roots = found.drop("moved")


def variants(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the texts.

    Words are runs of Latin letters, A-Z in lower case, of at least LENGTH code points that occur OCCURRENCES times
    over all texts; a run whose hash with the key is a multiple of TYPO loses a code point. n: occurrences, n_near:
    words that differ by one edit. form: the most frequent of these, the smallest of equals, if it occurs at least TIMES
    as often; root: the last of the forms of forms, or the word. Null and empty texts have no words, long texts and
    words are read whole. Rows without a key count as having an empty one; repeated rows count each. An empty table gives no
    rows, other columns are not read.
    """
    counts = counted(df, key, text).groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = materialize(counts.filter(F.col("n") >= OCCURRENCES))
    found = compared(placed(vocabulary)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    joined = vocabulary.join(found, "word", "left").withColumn("most", -F.col("best.order"))
    likely = F.col("most") >= TIMES * F.col("n")
    told = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("best.word")).alias("form"), F.when(likely, F.col("most")).alias("form_n")))
    roots = followed(told.filter("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
