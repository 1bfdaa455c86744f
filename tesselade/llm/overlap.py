"""Records of evaluation splits that also turn up in training.

Equal records are folded into classes first, so a group of copies costs one
class however large it is. Records are cut into content-defined chunks and the
digests joined across splits; pairs are then checked word by word, and the
lengths of their shared chunks summed into an overlap fraction of either record.
Chunks are cut within sentences, which may stand in another order, and once more
over the whole record, whose sentence ends may be lost. An edit destroys at most
two chunks, so a pair that fits shares all chunks but two an edit, in one of the
two ways to cut. Three filters keep the join small and lose no such pair:

- prefix: of an evaluation record only the rarest chunks are joined, as many as
  leave less than it must share among the rest;
- length: records that differ in a tenth of their words lie in buckets of word
  counts that the evaluation record covers;
- words: an edit changes at most two word counts by one, so the maps of counts
  by word hash, in Gray code, differ in at most two bits an edit. A small map
  goes through the join, a larger one then thins out the pairs.

A record of so few chunks that its edits may destroy all of them is joined by its
words too, of which a pair that fits shares all but one an edit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselade.llm.overlap_text import chunks, differing, sentences, views, word_counts
from tesselade.operators.joins import salted_join
from tesselade.session import materialise

MIN_WORDS = 60
MAX_DIFFERING = 0.1
HOT_CLASSES = 2000  # evaluation classes of one digest that are joined in one part
MAX_FEW = 200_000  # hot digests or popular classes that are broadcast; more are joined by a shuffle
COPIES = 20  # rows of one class whose chunks are joined; of more, one row's stand for all
SMALL, LARGE = 2, 4  # numbers of 64 bits in the maps of a record's word counts
VIEWS = 3  # chunks within sentences, chunks of the whole record, words


def image_key(path: Column) -> Column:
    """``\\`` read as ``/``; a leading ``./``, then ``dataset/`` or ``images/`` dropped."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", ""), "^(?:dataset|images)/", "")


def cut(said: list[list[str]]) -> tuple[dict[int, list[int]], list[int]]:
    """Counts a view by digest, and what a pair that fits shares in each view.

    A record that fits differs in at most a ninth of the words of this one,
    either within sentences in any order or as one sequence; it shares as much
    as is stated for either record in one of the views. 0: the view is unused.
    """
    whole = [w for s in said for w in s]
    limit = int(len(whole) * MAX_DIFFERING / (1 - MAX_DIFFERING) + 1e-9)
    found: dict[int, list[int]] = {}
    wanted = []
    for view, digests in enumerate(views(said)):
        for digest in digests:
            found.setdefault(digest, [0] * VIEWS)[view] += 1
        wanted.append(len(digests) - 2 * limit)
    if min(wanted) <= 0:
        for w in whole:
            found.setdefault(xxhash.xxh3_64_intdigest(w, seed=1), [0] * VIEWS)[2] += 1
        return found, [*(max(1, w) for w in wanted), len(whole) - limit]
    return found, [*wanted, 0]


def overlap(a: list[list[str]], b: list[list[str]]) -> tuple[float, float]:
    """Share of either record's words that stand in chunks of both, by the
    view that gives more."""

    def share(texts: list[list[str]], known: set[int]) -> float:
        covered = 0
        for t in texts:
            reached = 0
            for digest, start, end in chunks(t):
                if digest in known:
                    covered += end - max(start, reached)
                    reached = end
        return covered / max(1, sum(map(len, texts)))

    best = (0.0, 0.0)
    for left, right in ((a, b), ([[w for s in a for w in s]], [[w for s in b for w in s]])):
        both = {c[0] for t in left for c in chunks(t)} & {c[0] for t in right for c in chunks(t)}
        best = max(best, (share(left, both), share(right, both)))
    return best


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _packed(digest: int, counts: list[int]) -> int:
    """A digest of 52 bits and the counts of the views, 15 at most."""
    a, b, c = (min(n, 15) for n in counts)
    return _signed((digest >> 12 << 12) | a << 8 | b << 4 | c)


def _features(batches: Iterator[pd.DataFrame], min_words: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, image, train, test, row, text in pdf.itertuples(index=False, name=None):
            said = sentences(text)
            words = [w for s in said for w in s]
            if len(words) < min_words:
                out.append((key, image, train, test, row, None, None, 0, None, None, None))
                continue
            group = xxhash.xxh3_128_digest("\n".join(sorted(" ".join(s) for s in said)))
            found, wanted = cut(said)
            over = [sum(max(0, n[v] - 15) for n in found.values()) for v in range(VIEWS)]
            wanted = [max(1, w - x) if w else 0 for w, x in zip(wanted, over)]
            bits = word_counts(words, SMALL) + word_counts(words, LARGE)
            out.append((key, image, train, test, row, group, _signed(int.from_bytes(group[:8])), len(words), wanted, [_packed(d, n) for d, n in found.items()], bits))
        frame = pd.DataFrame(out, columns=["key", "image", "train", "eval", "row", "class", "id", "words", "wanted", "chunks", "bits"])
        yield frame.astype({"row": "Int64", "id": "Int64"})


@F.pandas_udf(T.StructType([T.StructField("train", T.DoubleType()), T.StructField("eval", T.DoubleType())]))
def _near(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Overlap fractions of both texts, null if they differ in too many words."""

    def one(x: str, y: str) -> tuple[float, float] | tuple[None, None]:
        left, right = sentences(x), sentences(y)
        limit = int(MAX_DIFFERING * max(sum(map(len, left)), sum(map(len, right))))
        return overlap(left, right) if differing(left, right, limit) <= limit else (None, None)

    return pd.DataFrame([one(x, y) for x, y in zip(a, b)], columns=["train", "eval"], dtype=float)


def _bucket(words: Column | float) -> Column:
    """Buckets of word counts a factor 1 / 0.81 wide."""
    return F.floor(F.log(words) / F.lit(-2 * math.log(1 - MAX_DIFFERING))).cast("int")


def _looked_up(rows: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """Left join with a table that is small as a rule: it is counted, and rows
    are moved only for one of more than ``MAX_FEW`` rows."""
    few = materialise(few)
    n = few.count()
    if n:
        return rows.join(F.broadcast(few) if n <= MAX_FEW else few, on, "left")
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in few.schema if f.name != on})


def _few_apart(maps: list[tuple[Column, Column]]) -> Column:
    """The maps of word counts of two records of tw and ew words are near enough."""
    turned = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in maps), F.lit(0))
    return turned <= 2 * F.floor(MAX_DIFFERING * F.greatest("tw", "ew") + 1e-9)


def _shared(rows: DataFrame) -> DataFrame:
    """(train_id, eval_id) of different classes that may be near, from one row
    or a few of each."""
    maps = [f"b{i}" for i in range(SMALL)]
    wide = rows.withColumn("words", F.col("words").cast("double"))
    rows = wide.select("id", "train", "eval", "words", "wanted", "chunks", *[F.col("bits")[i].alias(b) for i, b in enumerate(maps)])
    digest = F.shiftright("c", 12)
    # Of an evaluation record the hottest chunks stay out while they hold less than it must share.
    chunk = rows.where("eval").select("id", "words", "wanted", *maps, F.explode("chunks").alias("c")).withColumn("digest", digest)
    counted = chunk.groupBy("digest").agg(F.count("*").alias("df"))
    hottest = Window.partitionBy("id").orderBy(F.desc("df"), "digest")
    kept = chunk.join(counted, "digest")
    needed = F.lit(False)
    for view in range(VIEWS):
        n = F.shiftright("c", 8 - 4 * view).bitwiseAND(15)
        kept = kept.withColumn(f"upto{view}", F.sum(n).over(hottest))
        needed |= (n > 0) & (F.col(f"upto{view}") >= F.col("wanted")[view])
    # A digest of many classes is split by a hash of the training class; its evaluation side goes to every part.
    parts = F.ceil(F.col("df") / HOT_CLASSES).cast("int")
    hot = counted.where(F.col("df") > HOT_CLASSES).select("digest", parts.alias("parts"))
    covered = F.sequence(_bucket(F.col("words") * (1 - MAX_DIFFERING) - 1e-6), _bucket(F.col("words") / (1 - MAX_DIFFERING) + 1e-6))
    right = kept.where(needed).select(F.col("id").alias("eval_id"), F.col("words").alias("ew"), *[F.col(b).alias(f"e{b}") for b in maps], "digest", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), covered.alias("covered"))
    right = right.select("*", F.explode("covered").alias("bucket")).drop("covered")
    left = rows.where("train").select(F.col("id").alias("train_id"), F.col("words").alias("tw"), *[F.col(b).alias(f"t{b}") for b in maps], F.explode("chunks").alias("c"))
    left = left.withColumns({"digest": digest, "bucket": _bucket(F.col("tw"))}).drop("c")
    left = _looked_up(left, hot, "digest")
    left = left.withColumn("part", F.pmod(F.xxhash64("train_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    alike = (F.col("train_id") != F.col("eval_id")) & _few_apart([(F.col(f"t{b}"), F.col(f"e{b}")) for b in maps])
    met = left.join(right, ["digest", "bucket", "part"]).where(alike).select("train_id", "eval_id").distinct()
    larger = wide.groupBy("id").agg(F.first("words").alias("words"), F.first("bits").alias("bits"))
    met = met.join(larger.toDF("train_id", "tw", "tb"), "train_id").join(larger.toDF("eval_id", "ew", "eb"), "eval_id")
    return met.where(_few_apart([(F.col("tb")[i], F.col("eb")[i]) for i in range(SMALL, SMALL + LARGE)])).select("train_id", "eval_id")


def overlaps(df: DataFrame, splits: DataFrame, key: str, image: str, text: str) -> DataFrame:
    """(train_row, eval_row): the distinct rows of ``overlap_pairs``."""
    return overlap_pairs(df, splits, key, image, text).select("train_row", "eval_row").distinct()


def overlap_pairs(df: DataFrame, splits: DataFrame, key: str, image: str, text: str) -> DataFrame:
    """(train_row, eval_row, train_overlap, eval_overlap): all pairs with one
    side in each, a row a reason.

    A pair has one key, one image (see ``image_key``; null images match
    nothing) or nearly one text. ``splits`` gives (key, split), with ``train``
    for training and ``eval`` or ``holdout`` for evaluation; repeated lines
    and rows count once, keys without a split or a record give nothing but,
    for a key in both, the pair with itself. Null or short texts match by key
    or image only. Rows without key are left out. The fractions of words in
    shared chunks are 1 for equal texts and null for pairs by key or image.
    """
    role = splits.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col("split") == "train").alias("train"), F.max(F.col("split").isin("eval", "holdout")).alias("eval"))
    role = role.withColumns({"train": F.coalesce("train", F.lit(False)), "eval": F.coalesce("eval", F.lit(False))}).where("train or eval")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), image_key(F.col(image)).alias("image"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    named = f"key {dict(rows.dtypes)['key']}, image string, train boolean, eval boolean, row bigint"
    schema = f"{named}, class binary, id bigint, words int, wanted array<int>, chunks array<bigint>, bits array<bigint>"
    marked = rows.join(role, "key").select("key", "image", "train", "eval", "row", "text").mapInPandas(lambda batches: _features(batches, MIN_WORDS), schema)
    marked = materialise(marked.withColumn("at", F.monotonically_increasing_id()))
    # Copies of one record have one class, and one of them stands for a class of many.
    popular = marked.where("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.max("train").alias("t"), F.max("eval").alias("e")).where(F.col("n") > COPIES)
    popular = popular.select("class", F.col("at").alias("first"), "t", "e")
    standing = _looked_up(marked.where("class is not null"), popular, "class").where("first is null or first = at")
    standing = standing.withColumns({"train": F.coalesce("t", "train"), "eval": F.coalesce("e", "eval")})
    pairs = materialise(_shared(standing))
    wanted = pairs.select(F.col("train_id").alias("id")).union(pairs.select("eval_id")).distinct()
    stored = marked.where("class is not null").select("id", "row").join(wanted, "id").groupBy("id").agg(F.min("row").alias("row"))
    texts = materialise(rows.select("row", "text").join(stored, "row").groupBy("id").agg(F.first("text").alias("text")))
    near = pairs.join(texts.toDF("train_id", "a"), "train_id").join(texts.toDF("eval_id", "b"), "eval_id").select("train_id", "eval_id", _near("a", "b").alias("overlap"))
    near = near.where("overlap.eval is not null").select("train_id", "eval_id", F.col("overlap.train").alias("train_overlap"), F.col("overlap.eval").alias("eval_overlap"))
    member = marked.where("class is not null").select("key", "id", "class", "train", "eval").distinct()
    same = member.groupBy("class", "id").agg(F.max("train").alias("train"), F.max("eval").alias("eval")).where("train and eval")
    same = same.select(F.col("id").alias("train_id"), F.col("id").alias("eval_id"), F.lit(1.0).alias("train_overlap"), F.lit(1.0).alias("eval_overlap"))
    train = member.where("train").select(F.col("key").alias("train_row"), F.col("id").alias("train_id")).distinct()
    evals = member.where("eval").select(F.col("key").alias("eval_row"), F.col("id").alias("eval_id")).distinct()
    # Both joins multiply out groups of copies, so hot groups are split.
    columns = ["train_row", "eval_row", "train_overlap", "eval_overlap"]
    by_text = salted_join(train, near.union(same).join(evals, "eval_id").drop("eval_id"), ["train_id"]).select(*columns)
    shown = marked.where("image is not null").select("key", "image", "train", "eval").distinct()
    by_image = salted_join(shown.where("train").select(F.col("key").alias("train_row"), "image"), shown.where("eval").select(F.col("key").alias("eval_row"), "image"), ["image"]).select("train_row", "eval_row")
    by_key = role.where("train and eval").select(F.col("key").alias("train_row"), F.col("key").alias("eval_row"))
    unread = by_image.union(by_key).withColumns({c: F.lit(None).cast("double") for c in columns[2:]})
    return by_text.union(unread)
