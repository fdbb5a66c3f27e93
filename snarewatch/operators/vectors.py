"""Hashed text vectors, nearest neighbours among seeds, and MinHash near-duplicates."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from snarewatch.functions import constants as C
from snarewatch.functions import risk, urls
from snarewatch.functions.digests import window_heads
from snarewatch.sources.fixtures import kept

DIGITS = 6
TOKEN = r"[a-z0-9]+|[\x{1780}-\x{17FF}\x{19E0}-\x{19FF}]+"
HASHES, BANDS, PRIME = 64, 7, (1 << 31) - 1
SHINGLE = 8
BUCKETS = 256
#: Tokens and four-grams that a task remembers, some 8 MB, and characters of a remembered token.
MEMO, LONGEST = 50_000, 40
#: Tokens that have features.
_TOKEN = re.compile(r"[a-z0-9]{2,}|[\u1780-\u17FF\u19E0-\u19FF]{2,}")
_LEET = str.maketrans(C.LEET_FROM, C.LEET_TO)
_CODES = [i.to_bytes(2, "little") for i in range(1024)]
_WEIGHT = np.array([(1.0 if i & 512 else 0.5) * (-1 if i & 256 else 1) for i in range(1024)])
#: Matching positions of 64 that make two pages near-duplicates (0.90).
MATCHES = 58


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(urls.deleet(F.lower(F.coalesce(text, F.lit("")))), F.lit(TOKEN), F.lit(0))


def hashed_vectors(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse unit vectors in long form: key, bucket (0..255), w; no row for empty texts.

    A word of two characters or more weighs 1, each four-gram of ``^word$`` a half;
    md5 gives bucket and sign. Sums of halves are exact, so the order of rows is
    irrelevant. Partial sums by (key, bucket) run before the shuffle.
    """
    word = rows.select(key, F.explode(tokens(F.col(text))).alias("t"))
    padded = F.concat(F.lit("^"), F.col("t"), F.lit("$"))
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("t") - 1, F.lit(1))), lambda i: F.struct(F.concat(F.lit("c:"), F.substring(padded, i, F.lit(4))).alias("f"), F.lit(0.5).alias("w"))
    )
    grams = F.when(F.length("t") >= 2, grams).otherwise(F.slice(grams, 1, 0))
    whole = F.array(F.struct(F.concat(F.lit("w:"), F.col("t")).alias("f"), F.lit(1.0).alias("w")))
    each = word.select(key, F.explode(F.when(F.length("t") >= 2, F.concat(whole, grams)).otherwise(grams)).alias("x")).select(key, "x.w", F.md5(F.encode("x.f", "utf-8")).alias("h"))
    bucket = F.conv(F.substring("h", 1, 2), 16, 10).cast("int")
    sign = F.when(F.conv(F.substring("h", 10, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = each.groupBy(key, bucket.alias("bucket")).agg(F.sum(F.col("w") * sign).alias("s")).where("s <> 0")
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy(key)))
    return sums.withColumn("w", F.col("s") / norm).select(key, "bucket", "w")


def seed_texts(kinds: tuple[str, ...]) -> list[tuple[str, str, str, str]]:
    """Reference texts: kind, key, label, text. A fixed number, read off the constants."""
    rows = [("brand", d, label, d) for d, label in C.BRANDS.items()]
    roots: dict[str, str] = {}
    for domain, label in C.BRANDS.items():
        roots.setdefault(domain.split(".")[0], label)
    rows += [("phish", p.format(brand=r), f"{label} impersonation pattern", p.format(brand=r)) for r, label in roots.items() for p in C.PHISH_TEMPLATES]
    rows += [("scam_pattern", f"{c}:{i}", c, x) for c, texts in C.SCRIPTS.items() for i, x in enumerate(texts)]
    return [r for r in rows if r[0] in kinds]


def seed_usage(top: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Every seed of ``kinds`` with the number of rows among whose nearest it is: kind, key, label, n.

    ``top`` comes from ``nearest``; it is summed by seed before it is shuffled.
    """
    seeds = top.sparkSession.createDataFrame([r[:3] for r in seed_texts(kinds)], "kind string, key string, label string")
    used = top.groupBy("kind", F.col("seed_key").alias("key")).agg(F.count("*").alias("n"))
    return seeds.join(used.hint("merge"), ["kind", "key"], "left").select("kind", "key", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _code(feature: str, whole: bool) -> bytes:
    """Bucket, sign and kind of a feature in two bytes, one of 1024 objects."""
    h = hashlib.md5(feature.encode()).digest()
    return _CODES[h[0] | (h[4] & 1) << 8 | whole << 9]


def _features(token: str, memo: dict[str, bytes]) -> bytes:
    """The codes of a token's features. ``memo`` keeps them and those of four-grams, under ``c:``."""
    padded, codes = f"^{token}$", [_code("w:" + token, True)]
    for i in range(len(token) - 1):
        gram = "c:" + padded[i : i + 4]
        code = memo.get(gram)
        if code is None:
            code = _code(gram, False)
            if len(memo) >= MEMO:
                memo.clear()
            memo[gram] = code
        codes.append(code)
    found = b"".join(codes)
    if len(token) <= LONGEST:
        if len(memo) >= MEMO:
            memo.clear()
        memo[token] = found
    return found


def _weights(text: str, memo: dict[str, bytes]) -> np.ndarray:
    """``hashed_vectors`` of one text as 256 numbers, before scaling."""
    known = memo.get
    codes = np.frombuffer(b"".join([known(t) or _features(t, memo) for t in _TOKEN.findall(text.lower().translate(_LEET))]), "<u2")
    return np.bincount(codes & 0xFF, _WEIGHT[codes], BUCKETS)


def unit_rows(texts: list[str | None], memo: dict[str, bytes]) -> np.ndarray:
    """Unit vectors of texts, a row each; a text without tokens has a row of zeros. Equal texts are hashed once."""
    known = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    made = np.array([_weights(t or "", memo) for t in known], float).reshape(len(known), BUCKETS)
    made /= np.maximum(np.sqrt((made * made).sum(axis=1, keepdims=True)), 1e-300)
    return made if len(known) == len(texts) else made[[known[t] for t in texts]]


def _cosines(texts: list[str | None], matrix: np.ndarray, memo: dict[str, bytes]) -> np.ndarray:
    """Cosine of each text with each row of ``matrix``; -2, below any, where they have no bucket in common."""
    mine = unit_rows(texts, memo)
    near = np.round(mine @ matrix.T, DIGITS) + 0.0
    # small whole numbers are exact in four bytes
    near[((mine != 0).astype(np.float32) @ (matrix != 0).astype(np.float32).T) == 0] = -2
    return near


def nearest(rows: DataFrame, key: str, text: str, kinds: tuple[str, ...], k: int) -> DataFrame:
    """The ``k`` seeds of highest cosine for each text, exact, ties by (kind, key).

    Returns key, kind, seed_key, label, similarity, place (from 1); a seed that has no
    bucket in common with a text is none of its neighbours. The seeds are a fixed set
    of a few hundred vectors, so a task holds them as one matrix and rows stay where
    they are: nothing is shuffled.
    """
    seeds = sorted(seed_texts(kinds))
    names = ["kind", "seed_key", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bytes] = {}
        matrix = unit_rows([s[3] for s in seeds], memo)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                few = batch.slice(low, 1024)
                near = _cosines(few.column(1).to_pylist(), matrix, memo)
                # seeds are in the order of ties, and the sort keeps it
                order = np.argsort(-near, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(near, order, axis=1)
                row, place = np.nonzero(best > -2)
                found = [seeds[i] for i in order[row, place]]
                columns = [pa.array([f[i] for f in found], pa.string()) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [few.column(0).take(pa.array(row)), *columns, pa.array(best[row, place]), pa.array((place + 1).astype(np.int32))], names=[key, *names, "similarity", "place"]
                )

    kept = rows.select(key, text)
    return kept.mapInArrow(run, f"{key} {kept.schema[key].dataType.simpleString()}, kind string, seed_key string, label string, similarity double, place int")


def with_similarity(rows: DataFrame, text: str, kinds: tuple[str, ...], k: int) -> DataFrame:
    """``rows`` with a column ``<kind>_near`` a kind: the highest similarity to it among the ``k`` nearest seeds of all kinds.

    Null where none of them is of that kind. Rows stay where they are, all columns pass through.
    """
    seeds = sorted(seed_texts(kinds))
    of_kind = np.array([[s[0] == kind for s in seeds] for kind in kinds])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bytes] = {}
        matrix = unit_rows([s[3] for s in seeds], memo)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                few = batch.slice(low, 1024)
                near = _cosines(few.column(at).to_pylist(), matrix, memo)
                order = np.argsort(-near, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(near, order, axis=1)
                most = [np.where(kind[order] & (best > -2), best, -2).max(axis=1) for kind in of_kind]
                yield pa.RecordBatch.from_arrays([*few.columns, *(pa.array(m, mask=m <= -2) for m in most)], names=[*batch.schema.names, *(f"{kind}_near" for kind in kinds)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, schema + "".join(f", {kind}_near double" for kind in kinds))


def script_matches(messages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Best known script of each message with similarity ``threshold`` or more."""
    best = nearest(messages, "message_id", "text", ("scam_pattern",), 1)
    return best.where(F.col("similarity") >= threshold).select("message_id", F.col("seed_key").alias("script"), "label", "similarity")


def threshold_sweep(scored: DataFrame, steps: int = 100) -> DataFrame:
    """What every threshold would do: threshold, false_hits, misses and safe, a row for each of 0 to ``steps`` of ``steps``.

    ``scored`` has similarity and scripted (whether the text is one that should match); a text
    matches from the threshold on. ``safe`` is the window in which both are right: above the
    highest of the others and up to the lowest of the scripted. Texts are counted by step
    before they meet, so the sums run over ``steps`` rows.
    """
    at = F.floor(F.col("similarity") * steps).cast("int")
    n = scored.where("similarity is not null and scripted is not null").groupBy(F.greatest(F.least(at, F.lit(steps)), F.lit(-1)).alias("step")).agg(
        F.count_if("scripted").alias("good"), F.count_if(~F.col("scripted")).alias("bad"),
        F.min(F.when(F.col("scripted"), F.col("similarity"))).alias("low"), F.max(F.when(~F.col("scripted"), F.col("similarity"))).alias("high"),
    )
    zero = F.lit(0).cast("bigint")
    every = scored.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("step"), zero.alias("good"), zero.alias("bad"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    # a text on a step is at its threshold, so from its step on it is a match there
    whole = n.unionByName(every).groupBy("step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("low").alias("low"), F.max("high").alias("high"))
    from_here = Window.orderBy("step").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy()
    told = whole.select(
        "step", F.sum("bad").over(from_here).alias("false_hits"), F.coalesce(F.sum("good").over(before), zero).alias("misses"), F.min("low").over(over).alias("low"), F.max("high").over(over).alias("high"),
    ).where("step >= 0")
    threshold = F.col("step") / steps
    return told.select(threshold.alias("threshold"), "false_hits", "misses", ((threshold > F.coalesce("high", F.lit(-1.0))) & (threshold <= F.coalesce("low", F.lit(2.0)))).alias("safe"))


#: Reference vectors of ``dense_nearest``: they go to every task as one matrix.
MOST_CENTROIDS = 10_000


def dense_nearest(vectors: DataFrame, centroids: DataFrame, threshold: float = 0.74) -> DataFrame:
    """Best centroid of each dense vector by cosine, and whether it is near enough.

    ``centroids`` (centroid, c) is a reference set of at most MOST_CENTROIDS rows,
    checked here; ties go to the smallest. Null, empty and zero vectors, and those of
    another length than a centroid's, have cosine 0. Vectors stay where they are.
    """
    found = centroids.where("centroid is not null").orderBy("centroid").limit(MOST_CENTROIDS + 1).collect()
    if len(found) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    names, rows = [r.centroid for r in found], [np.array([x or 0.0 for x in r.c or []], float) for r in found]
    unit = [r / n if (n := np.sqrt(r @ r)) > 0 else r for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(u) for u in unit])
        for batch in batches:
            best, near = [], []
            for vector in batch.column(1).to_pylist():
                v = np.array([x or 0.0 for x in vector or []], float)
                sims, same, norm = np.zeros(len(unit)), np.flatnonzero(sizes == len(v)), np.sqrt(v @ v)
                if norm > 0 and len(same):
                    sims[same] = np.stack([unit[i] for i in same]) @ (v / norm)
                sims = np.round(sims, DIGITS) + 0.0
                i = int(sims.argmax())
                best.append(names[i])
                near.append(float(sims[i]))
            columns = [pa.array(best, kinds), pa.array(near, pa.float64()), pa.array([x >= threshold for x in near], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["vec_id", "centroid", "similarity", "near"])

    kept = vectors.select("vec_id", "embedding")
    kind = centroids.schema["centroid"].dataType
    kinds = to_arrow_type(kind)
    if not found:
        return kept.select("vec_id", F.lit(None).cast(kind).alias("centroid"), F.lit(0.0).alias("similarity"), F.lit(False).alias("near")).limit(0)
    return kept.mapInArrow(run, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, centroid {kind.simpleString()}, similarity double, near boolean")


def encode_dense(rows: DataFrame, key: str, text: str, encoder) -> DataFrame:
    """Vectors of texts by an encoder that the caller brings: key, embedding.

    ``encoder`` takes a list of texts and returns a two-dimensional array; it is sent
    to the tasks and called once a batch. A null text is empty.
    """
    kept = rows.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                few = batch.slice(low, 256)
                made = np.asarray(encoder([t or "" for t in few.column(1).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(list(made), pa.list_(pa.float32()))], names=[key, "embedding"])

    return kept.mapInArrow(run, f"{key} {kept.schema[key].dataType.simpleString()}, embedding array<float>")


def affine(i: int) -> tuple[int, int]:
    """Multiplier and offset of the i-th permutation of 31-bit numbers."""
    return (i * 1_103_515_245 + 12_345) % (PRIME - 1) + 1, (i * 214_013 + 2_531_011) % PRIME


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores where they come from fewer files than there are cores; of more files they stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def minhash(rows: DataFrame, key: str, text: str, *carried: str) -> DataFrame:
    """Signatures of 64 minima over the distinct 8-character shingles of each text.

    Returns key, signature and the ``carried`` columns.

    Texts are lower-cased and their white space collapsed; a shorter text is one
    shingle. One md5 a shingle, many at once; permutations are affine, modulo a prime,
    and stay below 2^62. Arrow batches and numpy do the arithmetic; nothing is shuffled.
    """
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
    steps = np.array([affine(i) for i in range(HASHES)], np.uint64)
    prime, half = np.uint64(PRIME), np.uint32(PRIME)

    def sign(heads: np.ndarray) -> np.ndarray:
        x = heads.astype(np.uint64) % prime
        least = np.full(HASHES, PRIME, np.uint32)
        for at in range(0, len(x), 1024):
            whole = x[at : at + 1024] * steps[:, :1]
            whole += steps[:, 1:]
            # modulo 2^31 - 1: the upper bits added to the lower ones, and the prime taken off once at most
            high = whole >> np.uint64(31)
            whole &= prime
            whole += high
            part = whole.astype(np.uint32)
            least = np.minimum(least, np.minimum(part, part - half).min(axis=1))
        return least.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                few = batch.slice(low, 256)
                signed = pa.array([sign(h) for h in window_heads(few.column(1).to_pylist(), SHINGLE)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([few.column(0), signed, *few.columns[2:]], names=[key, "signature", *carried])

    kept = rows.select(key, flat.alias("flat"), *carried)
    kind = lambda c: f"{c} {kept.schema[c].dataType.simpleString()}"
    return kept.mapInArrow(run, ", ".join([kind(key), "signature array<bigint>", *map(kind, carried)]))


def matching(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"]))


#: Classes of a band that one task compares with as many others.
BAND_BLOCK = 512


def signature_classes(signed: DataFrame) -> DataFrame:
    """One row a distinct signature: h1, h2 (its digest), id (smallest), host (its host), other (smallest id of another host).

    A parked page on millions of hosts is cut down to two rows in each task before it moves.
    """
    by_host = signed.groupBy("h1", "h2", "host").agg(F.min("id").alias("id"))
    two = by_host.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id", "host"))).where("n <= 2")
    least = F.min(F.struct("id", "host")).alias("one")
    return two.groupBy("h1", "h2").agg(least, F.max(F.when(F.col("n") == 2, F.col("id"))).alias("other")).select("h1", "h2", "one.id", "one.host", "other")


def band_partners(classes: DataFrame, matches: int = MATCHES, block: int = BAND_BLOCK) -> DataFrame:
    """Best partner on another host of each class that has one host: id, other, matches (a row a task that finds one).

    ``classes`` has id, host, other and signature. Classes meet in the bands that they share,
    and of a band of many classes blocks meet blocks, each in a task of its own that puts out
    one row a class at most. Bands of one class go before signatures move.
    """
    cuts = [HASHES * i // BANDS for i in range(BANDS + 1)]
    bands = F.array(*[F.xxhash64(F.lit(i), F.slice("signature", a + 1, b - a)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    rows = classes.select("id", F.explode(bands).alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    live = rows.join(shared.repartition(F.xxhash64("band")).hint("merge"), "band").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    wide = live.join(classes.hint("merge"), "id")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    columns = ["band", "i", "j", "side", "id", "host", "other", "signature"]
    right = wide.withColumn("i", F.explode(every)).withColumn("j", F.col("own")).withColumn("side", F.lit(0)).select(columns)
    left = wide.where("other is null").withColumn("i", F.col("own")).withColumn("j", F.explode(every)).withColumn("side", F.lit(1)).select(columns)
    stream = right.unionByName(left).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            side = batch.column(3).to_pylist()
            at = 0
            while at < batch.num_rows:
                end = at
                while end < batch.num_rows and end < at + 128 and (places[end], side[end]) == (places[at], side[at]):
                    end += 1
                if places[at] != now:
                    now, held, block = places[at], [], None
                few = batch.slice(at, end - at)
                signatures = few.column(7).flatten().to_numpy().reshape(-1, HASHES)
                part = (few.column(4).to_numpy(), np.array(few.column(5).to_pylist(), object), np.array([x if x is not None else -1 for x in few.column(6).to_pylist()], np.int64), signatures)
                at = end
                if side[end - 1] == 0:
                    held.append(part)
                    continue
                if block is None:
                    block = tuple(np.concatenate([h[i] for h in held]) for i in range(4))
                ids, hosts, second, theirs = block
                # a class on the same host answers with its id on another one, if it has one
                same = part[1][:, None] == hosts
                who = np.where(same, second, ids)
                equal = (signatures[:, None] == theirs).sum(axis=2)
                good = (equal >= matches) & (part[0][:, None] != ids) & ~(same & (second == -1))
                rank = np.where(good, equal, -1)
                most = rank.max(axis=1)
                found = np.flatnonzero(most >= 0)
                if len(found):
                    best = np.where(rank[found] == most[found, None], who[found], np.iinfo(np.int64).max).min(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(part[0][found]), pa.array(best), pa.array(most[found].astype(np.int32))], names=["id", "other", "matches"])

    return stream.mapInArrow(run, "id bigint, other bigint, matches int")


def near_duplicates(signed: DataFrame, matches: int = MATCHES, block: int = BAND_BLOCK) -> DataFrame:
    """Best other-host partner of each signature: id, other, matches; ties go to the smallest id.

    Equal signatures are one class, of which two ids say all: the smallest, and the
    smallest of another host. A class on several hosts is its own best partner. For
    the rest, seven bands cannot all miss when at most six of 64 positions differ, so
    joining classes on bands finds every pair at or above the threshold. ``signed`` has
    id (distinct), host and signature; it is written once, as texts are signed only once.
    """
    digest = {"h1": F.xxhash64("signature"), "h2": F.xxhash64(F.lit("second"), "signature")}
    signed = kept(signed.select("id", "host", "signature").withColumns(digest))
    classes = kept(signature_classes(signed.drop("signature")))
    wide = classes.join(signed.select("id", "signature").hint("merge"), "id").select("id", "host", "other", "signature")
    met = band_partners(wide, matches, block).groupBy("id").agg(F.min(F.struct((-F.col("matches")).alias("m"), F.col("other").alias("partner"))).alias("b"))
    known = classes.join(met.hint("merge"), "id", "left").where("other is not null or b is not null")
    known = known.select("h1", "h2", F.col("id").alias("first"), F.col("host").alias("first_host"), "other", "b").repartition(F.xxhash64("h1", "h2"))
    own = F.when(F.col("first_host") != F.col("host"), F.col("first")).otherwise(F.col("other"))
    several = F.col("other").isNotNull()
    rows = signed.select("id", "host", "h1", "h2").join(known.hint("merge"), ["h1", "h2"])
    return rows.select(
        "id", F.when(several, own).otherwise(F.col("b.partner")).alias("other"), F.when(several, F.lit(HASHES)).otherwise(-F.col("b.m")).cast("int").alias("matches")
    )
