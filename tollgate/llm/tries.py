"""The prefix trie of rebuilt conversations, from composable fingerprints.

A conversation c is rebuilt from the first h turns of the conversation c - c % 5 and its own turns after its first h, with h the crc32 of
its number modulo 9. No rebuilt text is ever made. The fingerprint of a sequence of turns is a product in a monoid: a pair (B^k, H) for
each of three primes, with (B^j, G) (B^k, H) = (B^(j + k), G B^k + H). Stored turns get the products of their conversation up to them;
the fingerprint of a rebuilt prefix is then the product of a head of one conversation and, symbolically, of a suffix of another:
P_c[k] + (P_head - P_c[h]) B^(k - h).

1. Turns are dealt by ranges of (conversation, turn, role, beginning of the text) and multiplied up inside each range; a conversation that
   goes on in the next range is carried on by one product for each range.
2. Every rebuilt prefix is an entry (depth, fingerprint, conversation, reference of its last turn), and a group of entries is a node. The
   reference is a digest of role and text. Two aggregates verify that groups are equal sequences: a digest belongs to one role and text, and
   all entries of a node have one last digest; the parent's fingerprint follows from fingerprint and digest, so all turns above agree too.
   If either fails, all is done again with other digests.
3. The nodes whose smallest member is c are the lower end of the path of c: from some depth down to its last turn. The trie is thus a tree of
   paths. Sums over subtrees are sums along paths, in buckets of `BUCKET` nodes, and totals of paths, which pointer doubling adds up in as
   many rounds as the logarithm of the nesting.
4. The numbers of the conversations that end at a node are sorted over ranges, written out in chunks, and the chunks hashed in order.

Turns of a conversation are ordered by turn (nulls first), then role and text in bytes; repeated rows are turns of their own. Null role and
text are empty. Rows with a null conv_id are one conversation, which keeps its own turns, names a node only if it is alone there, and counts
as an empty text, first in the list of ends. c % 5 has the sign of c. No rows have no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.common import parts, pinned
from tollgate.llm.repair import arrow, batched, rows_of

# Three primes below 2^31, the base of the products, and the rule of rebuilding.
PRIMES = (2147483647, 2147483629, 2147483587)
BASE = 1_000_003
MOST_HEAD, STEP = 8, 5
INVERSES = [pow(BASE, -1, p) for p in PRIMES]

BUCKET = 4_096  # nodes of one path that are added up together
CHUNK_CHARS = 1 << 16
AXES = range(len(PRIMES))
PRINT = [f"f{i}" for i in AXES]
SCANNED = ("conv bigint, part int, idx bigint, pos bigint, s0 bigint, s1 bigint, bytes bigint, "
           + ", ".join(f"f{i} bigint, b{i} bigint" for i in AXES))


def residue(axis: int) -> Column:
    """The turn's factor for one prime, from its digest."""
    mixed = (F.col("s0"), F.col("s1"), F.col("s0").bitwiseXOR(F.shiftright("s1", 7)))[axis]
    return F.pmod(mixed, F.lit(PRIMES[axis]))


def parent_print(axis: int) -> Column:
    """The fingerprint without the last turn."""
    return F.pmod(F.col(f"f{axis}") - residue(axis), F.lit(PRIMES[axis])) * INVERSES[axis] % PRIMES[axis]


def key_of(conv: Column) -> Column:
    return F.coalesce(conv.cast("string"), F.lit(""))


def same(left: str, right: str, names: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{x}").eqNullSafe(F.col(f"{right}.{x}")) for x in names])


# ---- products of stored turns ---------------------------------------------------------------------------

def scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Position and product of every turn since the beginning of its conversation in this range."""
    part = TaskContext.get().partitionId()

    def found():
        at, known, pos = None, False, 0
        for idx, (conv, s0, s1, size, *factors) in enumerate(rows_of(batches)):
            if not known or conv != at:
                at, known, pos, h, b = conv, True, 0, [0] * len(PRIMES), [1] * len(PRIMES)
            pos += 1
            h = [(x * BASE + f) % p for x, f, p in zip(h, factors, PRIMES)]
            b = [x * BASE % p for x, p in zip(b, PRIMES)]
            yield (conv, part, idx, pos, s0, s1, size, *(x for pair in zip(h, b) for x in pair))

    return batched(found(), schema, 8192)


def carries(scanned: DataFrame) -> DataFrame:
    """(part, conv, count, product) that the first conversation of a range has from earlier ranges: one row for a range at most."""
    state = F.struct("conv", "pos", *PRINT, *[f"b{i}" for i in AXES])
    ends = scanned.groupBy("part").agg(F.min_by(F.struct("conv"), "idx").alias("first"), F.max_by(state, "idx").alias("last")).collect()
    out, before = [], None
    for r in sorted(ends, key=lambda r: r.part):
        h, b, count = [0] * len(PRIMES), [1] * len(PRIMES), 0
        if before is not None and before[0] == r.first.conv:
            _, count, h, b = before
            out.append((r.part, r.first.conv, count, *h, *b))
        if r.first.conv != r.last.conv:
            h, b, count = [0] * len(PRIMES), [1] * len(PRIMES), 0
        end = r.last
        before = (end.conv, count + end.pos, [(x * end[f"b{i}"] + end[f"f{i}"]) % PRIMES[i] for i, x in enumerate(h)],
                  [x * end[f"b{i}"] % PRIMES[i] for i, x in enumerate(b)])
    names = "part int, conv bigint, count bigint, " + ", ".join([f"h{i} bigint" for i in AXES] + [f"c{i} bigint" for i in AXES])
    return scanned.sparkSession.createDataFrame(out, names)


def digested(conversations: DataFrame, seed: int) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                role.alias("role"), text.alias("text"))
    return rows.withColumns({f"s{k}": F.xxhash64(F.lit(2 * seed + k), "role", F.lit(2 * seed + k), "text") for k in (0, 1)})


def multiplied(turns: DataFrame) -> DataFrame:
    """conv, pos, s0, s1, bytes and, for each prime, the product f of the turns up to this one and the power b."""
    dealt = turns.repartitionByRange(parts(turns), "conv", "turn", "role", F.substring("text", 1, 24)).sortWithinPartitions(
        "conv", "turn", "role", "text")
    schema = arrow(SCANNED)
    scanned = pinned(dealt.select("conv", "s0", "s1", F.octet_length("text").cast("long"), *map(residue, AXES)).mapInArrow(
        lambda batches: scan(batches, schema), SCANNED))
    joined = scanned.alias("l").join(F.broadcast(carries(scanned)).alias("r"), same("l", "r", ["part", "conv"]), "left")
    made = [((F.coalesce(f"r.h{i}", F.lit(0)) * F.col(f"l.b{i}") + F.col(f"l.f{i}")) % PRIMES[i]).alias(f"f{i}") for i in AXES]
    made += [(F.coalesce(f"r.c{i}", F.lit(1)) * F.col(f"l.b{i}") % PRIMES[i]).alias(f"b{i}") for i in AXES]
    return joined.select("l.conv", (F.coalesce("r.count", F.lit(0)) + F.col("l.pos")).alias("pos"), "l.s0", "l.s1", "l.bytes", *made)


# ---- nodes ----------------------------------------------------------------------------------------------

def entries(turns: DataFrame) -> DataFrame:
    """depth, fingerprint, conversation, digest and bytes of the last turn, and `ends`, of every rebuilt prefix."""
    heads = turns.groupBy("conv").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(F.when(
        F.col("pos") <= MOST_HEAD, F.struct("pos", *PRINT, "s0", "s1", "bytes")))).alias("head"))
    convs = pinned(heads.withColumn("h", (F.crc32(key_of(F.col("conv"))) % (MOST_HEAD + 1)).cast("int")))
    bases = convs.select(F.col("conv").alias("base"), F.col("head").alias("taken"))
    found = convs.withColumn("base", F.col("conv") - F.col("conv") % STEP).join(bases, "base", "left")
    found = found.withColumn("hb", F.least("h", F.coalesce(F.size("taken"), F.lit(0))))

    def upto(head: str, count: str, axis: int) -> Column:
        return F.coalesce(F.get(F.col(head), F.col(count) - 1)[f"f{axis}"], F.lit(0))

    plan = pinned(found.select("conv", "h", "hb", F.slice(F.coalesce("taken", F.array().cast(convs.schema["head"].dataType)), F.lit(1), F.col("hb")).alias("taken"),
                               (F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
                               *[F.pmod(upto("taken", "hb", i) - upto("head", "h", i), F.lit(PRIMES[i])).alias(f"d{i}") for i in AXES]))
    out = ["depth", *PRINT, "conv", "s0", "s1", "bytes", "ends"]
    root = plan.select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(f) for f in PRINT], "conv",
                       *[F.lit(0).cast("long").alias(c) for c in ("s0", "s1", "bytes")], (F.col("length") == 0).alias("ends"))
    lent = plan.select("conv", "length", F.explode("taken").alias("x")).select("conv", "length", F.col("x.pos").alias("depth"), "x.*")
    lent = lent.withColumn("ends", F.col("depth") == F.col("length")).select(*out)
    own = turns.alias("l").join(plan.drop("taken").alias("r"), same("l", "r", ["conv"])).where("l.pos > r.h").drop(F.col("r.conv"))
    lift = [F.element_at(F.array(*[F.lit(pow(INVERSES[i], h, PRIMES[i])).cast("long") for h in range(MOST_HEAD + 1)]), F.col("h") + 1) for i in AXES]
    own = own.withColumns({"depth": F.col("hb") + F.col("pos") - F.col("h"), **{
        f"f{i}": (F.col(f"f{i}") + F.col(f"d{i}") * (F.col(f"b{i}") * lift[i] % PRIMES[i])) % PRIMES[i] for i in AXES}})
    own = own.withColumn("ends", F.col("depth") == F.col("length")).select(*out)
    return root.unionByName(lent).unionByName(own)


def grouped(found: DataFrame) -> DataFrame:
    """One row for each node, with `u`, the key of its smallest member, and `tail`, whether that member ends here."""
    nodes = found.groupBy("depth", *PRINT).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
        F.coalesce(F.min_by("ends", "conv"), F.max("ends")).alias("tail"),
        F.min("s0").alias("s0"), F.min("s1").alias("s1"), ((F.min("s0") != F.max("s0")) | (F.min("s1") != F.max("s1"))).alias("mixed"))
    return nodes.withColumn("u", key_of(F.col("conv")))


def verified_nodes(conversations: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Entries and nodes, with digests under which no two different sequences share a fingerprint."""
    while True:
        turns = digested(conversations, seed)
        shared = turns.groupBy("s0", "s1", "role", "text").agg(F.lit(1).alias("one")).groupBy("s0", "s1").count().where("count > 1")
        if shared.isEmpty():
            found = pinned(entries(multiplied(turns)))
            nodes = pinned(grouped(found))
            if nodes.where("mixed").isEmpty():
                return found, nodes
        seed += 1


# ---- sums over subtrees ---------------------------------------------------------------------------------

def path_totals(paths: DataFrame) -> DataFrame:
    """(u, leaves, saved) with the sums over all paths below, from (u, up, leaves, saved), by pointer doubling."""
    state = pinned(paths)
    while not state.where("up is not null").isEmpty():
        add = state.where("up is not null").groupBy(F.col("up").alias("u")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        jump = state.select(F.col("u").alias("up"), F.col("up").alias("next"))
        state = pinned(state.join(add, "u", "left").join(jump, "up", "left").select(
            "u", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
    return state.drop("up")


def summed(nodes: DataFrame) -> DataFrame:
    """`nodes` with parent_conv_id, n_children, n_leaves and saved_tokens."""
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    tops = nodes.groupBy("u").agg(F.min("depth").alias("depth"), F.min_by(F.struct(*[parent_print(i).alias(f"f{i}") for i in AXES]), "depth").alias("x"))
    above = nodes.select(F.col("u").alias("up"), F.col("conv").alias("parent"), (F.col("depth") + 1).alias("depth"), *PRINT)
    tops = pinned(tops.select("u", "depth", "x.*").join(above, ["depth", *PRINT], "left").select("u", "depth", "up", "parent"))
    kids = tops.where("up is not null").groupBy(F.col("up").alias("u"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = nodes.join(kids, ["u", "depth"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    nodes = pinned(nodes.withColumns({"leaves": (F.col("tail") & (F.col("kids") == 0)).cast("long"), "saved": saved}).drop("s0", "s1", "mixed"))
    weights = nodes.groupBy("u").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = path_totals(tops.select("u", "up").join(weights, "u"))
    below = tops.join(totals, "u").where("up is not null").groupBy(F.col("up").alias("u"), (F.col("depth") - 1).alias("depth")).agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    nodes = nodes.join(below, ["u", "depth"], "left").join(tops.drop("up").withColumn("top", F.lit(True)), ["u", "depth"], "left")
    nodes = nodes.select("depth", *PRINT, "conv", "n_convs", "u", F.when(F.col("top"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
                         (F.col("kids") + F.when(F.col("tail"), 0).otherwise(1)).alias("n_children"),
                         (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                         (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
                         F.floor(F.col("depth") / BUCKET).alias("bucket"))
    nodes = pinned(nodes)
    deeper = Window.partitionBy("u").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = nodes.groupBy("u", "bucket").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).select(
        "u", "bucket", F.sum("l").over(deeper).alias("later_leaves"), F.sum("s").over(deeper).alias("later_saved")).where("later_leaves is not null")
    inside = Window.partitionBy("u", "bucket").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumns({"leaves": F.sum("leaves").over(inside), "saved": F.sum("saved").over(inside)})
    return nodes.join(rest, ["u", "bucket"], "left").select(
        "depth", *PRINT, "conv", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("later_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("later_saved", F.lit(0))).alias("saved_tokens"))


# ---- digests of the ends --------------------------------------------------------------------------------

def listed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Comma-joined numbers of sorted (node, conversation) rows, in chunks."""
    part = TaskContext.get().partitionId()

    def found():
        at, held, size, number = None, [], 0, 0
        for *node, conv in rows_of(batches):
            if held and (node != at or size > CHUNK_CHARS):
                yield (*at, part, number, ",".join(held))
                held, size, number = [], 0, number + 1
            at = node
            held.append("" if conv is None else str(conv))
            size += len(held[-1]) + 1
        if held:
            yield (*at, part, number, ",".join(held))

    return batched(found(), schema, 64)


def hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Digests of the chunks of each node, in order."""
    def found():
        at, state = None, None
        for *node, _, _, text in rows_of(batches):
            if node != at:
                if at is not None:
                    yield (*at, state.hexdigest())
                at, state = node, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if at is not None:
            yield (*at, state.hexdigest())

    return batched(found(), schema)


def end_digests(found: DataFrame) -> DataFrame:
    node = ["depth", *PRINT]
    key, n = ", ".join(f"{c} bigint" for c in node), parts(found)
    chunk, digest = f"{key}, part int, number bigint, text string", f"{key}, ends_sha256 string"
    chunk_schema, digest_schema = arrow(chunk), arrow(digest)
    chunks = (found.where("ends").select(*node, "conv").repartitionByRange(n, *node, "conv").sortWithinPartitions(*node, "conv")
              .mapInArrow(lambda batches: listed(batches, chunk_schema), chunk))
    return (chunks.repartition(n, *node).sortWithinPartitions(*node, "part", "number")
            .mapInArrow(lambda batches: hashed(batches, digest_schema), digest))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    found, nodes = verified_nodes(conversations)
    nothing = hashlib.sha256(b"").hexdigest()
    return summed(nodes).join(end_digests(found), ["depth", *PRINT], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
