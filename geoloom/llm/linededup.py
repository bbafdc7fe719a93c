"""Removal of lines that repeat an earlier one, by an exact set-similarity join, with DataFrame functions only.

A line's tokens are its distinct shingles of five words; a line of fewer words is one shingle of all of them. Tokens
are ordered by rarity: a shingle counts as the rarer the rarer its words are, the last ones above all; words are counted
in all documents, in a fixed number of buckets.
Two lines at the threshold share a token in their prefixes (prefix filter), have like numbers of tokens
(length filter), and enough tokens up to and after the shared one (positional filter); what is left is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, let, written

WIDTH = 5
#: The similarity, as a fraction, so that it is compared in whole numbers.
ALIKE = (4, 5)
#: Buckets of the words' counts (a power of two): their number bounds what is sent to the executors.
BUCKETS = 16_384
#: Bytes up to which a table is broadcast, as its rows and arrays add up to; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20
#: Lines with the same token that one task compares with all others of it; where more have it, they are dealt in as many blocks.
BLOCK = 2048

#: 64-bit words of the sets of bits that stand for lines before their tokens are compared.
WORDS = 8
#: A token's bits for its hash; those above are for its weight.
_HASH_BITS = 54
#: Fixed value: what stands between words.
NO_WORD = r"[^\p{L}\p{M}\p{N}]+"


def words_of(line: Column) -> Column:
    """The words of a line: letters, marks and digits, in lower case."""
    return F.array_remove(F.split(F.lower(line), NO_WORD), "")


def _low(number: Column, bits: int) -> Column:
    return number.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def bucket(hashed: Column) -> Column:
    """The bucket of a word's 64-bit hash."""
    return hashed.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def rarity(docs: DataFrame, text: str, width: int) -> Column:
    """For each bucket the weight of its words, as a constant array of numbers for tokens_of.

    A weight is the binary logarithm of the number of a bucket's words in all documents against the rarest bucket's. Words are counted as they stand between spaces, which needs no pattern and is
    exact but for those with a sign beside them; any weights that are the same for all lines give the same result.
    """
    words = docs.select(F.explode(F.split(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w <> ''")
    counts = words.groupBy(bucket(F.xxhash64("w")).alias("b")).count().collect()
    least, most = min((r["count"] for r in counts), default=1), max(1, 511 // (2**width - 1))
    by_bucket = {r["b"]: min((r["count"] // least).bit_length(), most) << _HASH_BITS for r in counts}
    return F.expr("array(" + ", ".join(f"{by_bucket.get(b, 0)}L" for b in range(BUCKETS)) + ")")


def tokens_of(words: Column, weights: Column, width: int) -> Column:
    """The distinct tokens of at least width words, the rarest first: of each shingle its words' weights above, and a hash below.

    A word is one number, its weight above and a hash below, and a shingle is the sum of its words' numbers, the k-th times 2 ** k:
    that takes few steps for each, and no carry reaches the weights or the sign.
    """
    word = F.transform(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.get(weights, bucket(h)) + F.shiftrightunsigned(h, 64 - (_HASH_BITS - width - 1)))

    def joined(a: Column, n: int, b: Column, m: int) -> Column:
        """The sums of n words from sums of m words, and of n - m words that follow."""
        size = F.size(words) - (n - 1)
        return F.zip_with(F.slice(a, F.lit(1), size), F.slice(b, F.lit(m + 1), size), lambda x, y: x + F.shiftleft(y, m))

    def of(x: Column, n: int) -> Column:
        if n == 1:
            return x
        return let(of(x, n // 2), lambda half: joined(half, n, half, n // 2)) if n % 2 == 0 else joined(of(x, n - 1), n, x, n - 1)

    return F.array_distinct(F.sort_array(let(word, lambda x: of(x, width))))


def bits_of(sets: DataFrame, token: str, *key: str) -> DataFrame:
    """For each key a set of 64 * WORDS bits, of which each of its tokens sets one, as columns b0, b1 and so on."""
    t = F.col(token)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _low(F.shiftright(t, 8), 6).cast("int"))
    which = _low(t, 8) % WORDS
    return sets.groupBy(*key).agg(*[F.bit_or(F.when(which == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(WORDS)])


def prefix_length(n: Column, alike: tuple[int, int]) -> Column:
    """How many of n tokens, the rarest first, hold one of any set's that is alike: n less the least overlap, and one."""
    return (n - F.ceil(n * alike[0] / alike[1]) + 1).cast("int")


def is_alike(a: Column, b: Column, alike: tuple[int, int]) -> Column:
    """Whether common tokens are as large a share of all: written so that the common ones are computed once."""
    return F.size(F.array_intersect(a, b)) * (alike[0] + alike[1]) >= (F.size(a) + F.size(b)) * alike[0]


def can_be_alike(a: Column, b: Column, at_a: Column, at_b: Column, alike: tuple[int, int]) -> Column:
    """The length and the positional filter, for sets of a and b tokens with a common one at these places (from 0)."""
    most = F.least(at_a, at_b) + 1 + F.least(a - at_a - 1, b - at_b - 1)
    return (a * alike[1] >= b * alike[0]) & (b * alike[1] >= a * alike[0]) & (most * (alike[0] + alike[1]) >= (a + b) * alike[0])


def bits_can_be_alike(a: Column, b: Column, differing: Column, alike: tuple[int, int]) -> Column:
    """Whether sets of a and b tokens can be alike when so many bits differ: each of those stands for a token that only one has."""
    return (a + b - differing) * (alike[0] + alike[1]) >= (a + b) * (2 * alike[0])


def _small(df: DataFrame, row_bytes: int = 40, elements: Column | None = None, element_bytes: int = 0) -> DataFrame:
    """df with a broadcast hint if its rows, and the elements of its arrays, take few enough bytes; it must be cheap to read."""
    size = F.count("*") * row_bytes if elements is None else F.count("*") * row_bytes + F.coalesce(F.sum(elements), F.lit(0)) * element_bytes
    return F.broadcast(df) if df.agg(size).first()[0] <= BROADCAST_BYTES else df


def _with_partner(members: DataFrame, condition, extra: list[str]) -> DataFrame:
    """The members (token, blocks, c, d and others) for which another class with the token fits condition(own column, other's column).

    A token's members are dealt into blocks by their hash, and each block meets all of the token's members: no task takes more than a
    block times those, and nothing but members comes out.
    """
    own = F.pmod(F.xxhash64("c", "d"), F.col("blocks")).cast("int")
    names = ["token", "c", "d", *extra]
    others = members.select(*[F.col(x).alias(f"o_{x}") for x in names], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o_block"))
    differ = (F.col("c") != F.col("o_c")) | (F.col("d") != F.col("o_d"))
    fits = condition(F.col, lambda x: F.col(f"o_{x}"))
    return members.withColumn("block", own).join(others, (F.col("token") == F.col("o_token")) & (F.col("block") == F.col("o_block")) & differ & fits, "left_semi").drop("block")


def repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """(doc_id, key, lines): for each document with lines to remove, by id and hash of its text, their numbers from 0.

    A line goes if an earlier one, by document id and then by its number, is alike. Null ids come first. Lines of
    repeated rows stand at the same place, so none of those is the earlier one. A line of fewer than width words is one shingle,
    so it repeats lines of the same words alone; lines without words have no tokens and are never removed.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
    weights = rarity(docs, "text", width)
    # Lines with the same words are one class; the second hash keeps classes apart at any number of lines.
    lines = docs.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("no", "line")).select("doc_id", "key", "no", words_of(F.col("line")).alias("words"))
    # Lines of one shingle are alike if they are of one class, so they need no tokens to meet.
    tokens = F.when(F.size("words") >= width, tokens_of(F.col("words"), weights, width)).when(F.size("words") > 0, F.array().cast("array<bigint>"))
    lines = lines.select("doc_id", "key", "no", F.xxhash64("words").alias("c"), F.hash("words", F.lit(1)).alias("d"), tokens.alias("t"))
    kept = lines.select("doc_id", "key", "no", "c", "d", F.size("t").alias("n"), F.slice("t", F.lit(1), prefix_length(F.size("t"), alike)).alias("prefix"))
    # Lines without words are left out after they are written: a filter before it would cut all lines into words twice.
    kept = written(kept).where("prefix is not null")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "no", "key")
    classes = kept.groupBy("c", "d").agg(F.min(F.struct(place.alias("first"), "n", "prefix")).alias("m"), F.count("*").alias("times"))
    classes = written(classes.select("c", "d", "m.first", "m.n", "m.prefix", "times"))

    # Tokens that several classes have in their prefixes; of tokens with the same classes one does.
    postings = classes.where("n > 1").select("c", "d", "n", F.posexplode("prefix").alias("at", "token"))
    shared = checkpointed(postings.groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1").select("token"))
    met = checkpointed(postings.join(_small(shared), "token"))
    single = met.groupBy("token").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("c", "d")).alias("x")).groupBy("k", "x").agg(F.min("token").alias("token"))
    single = checkpointed(single.select("token", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")))
    members = met.join(_small(single), "token")
    members = checkpointed(_with_partner(members, lambda a, b: can_be_alike(a("n"), b("n"), a("at"), b("at"), alike), ["n", "at"]))

    # The whole tokens of their lines, from the documents where they first stand; each of those is cut into lines once.
    wanted = checkpointed(members.select("c", "d").distinct())
    wanted = classes.select("c", "d", "first").join(_small(wanted), ["c", "d"])
    wanted = checkpointed(wanted.groupBy(F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__key")).agg(F.collect_list(F.struct("first", "c", "d")).alias("lines")))
    source = docs.join(_small(wanted, 40, F.size("lines"), 72), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")))
    found = let(F.split("text", "\n"), lambda x: F.transform("lines", lambda e: F.struct(e["c"].alias("c"), e["d"].alias("d"), e["first"].alias("first"), F.get(x, e["first"]["no"]).alias("line"))))
    whole = source.select(F.explode(found).alias("e")).select("e.c", "e.d", "e.first", words_of(F.col("e.line")).alias("words"))
    whole = checkpointed(whole.select("c", "d", "first", tokens_of(F.col("words"), weights, width).alias("tokens")))

    # Lines that nothing else can be alike by their sets of bits go before tokens are compared.
    words = [f"b{k}" for k in range(WORDS)]
    members = members.join(bits_of(whole.select("c", "d", F.explode("tokens").alias("t")), "t", "c", "d"), ["c", "d"])

    def near(a, b) -> Column:
        differing = sum((F.bit_count(a(x).bitwiseXOR(b(x))) for x in words), F.lit(0))
        return can_be_alike(a("n"), b("n"), a("at"), b("at"), alike) & bits_can_be_alike(a("n"), b("n"), differing, alike)

    likely = checkpointed(_with_partner(members, near, ["n", "at", *words]).select("token", "blocks", "c", "d", "n", "at"))
    # Repeated rows have their lines in whole as often; any one of them does.
    chosen = whole.join(_small(checkpointed(likely.select("c", "d").distinct())), ["c", "d"], "left_semi").dropDuplicates(["c", "d"])
    full = likely.join(chosen, ["c", "d"])
    earlier = lambda a, b: (b("first") < a("first")) & can_be_alike(a("n"), b("n"), a("at"), b("at"), alike) & is_alike(a("tokens"), b("tokens"), alike)
    later = _with_partner(full, earlier, ["n", "at", "first", "tokens"]).select("c", "d").distinct()

    # A class that repeats an earlier one loses all its lines, any other all but the first.
    later = checkpointed(later.withColumn("goes", F.lit(True)))
    marked = checkpointed(classes.select("c", "d", "first", "times").join(_small(later), ["c", "d"], "left").where("times > 1 or goes"))
    found = kept.select("doc_id", "key", "no", "c", "d").join(_small(marked, 80), ["c", "d"])
    removed = found.where(F.col("goes") | (F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "no", "key") > F.col("first")))
    return removed.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("no")).alias("lines"))


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """docs, with all their columns, without the lines that repeat an earlier one, and with the numbers of those, in column removed_lines.

    The text keeps its other lines, in order. Null and empty texts stay as they are; a text whose lines all
    go is empty. Extra columns stay whatever their names; only one named removed_lines gives way.
    """
    key, mine, other_key, other, numbers = (free_name(docs, c) for c in ("key", "id", "their_key", "their_id", "numbers"))
    gone = checkpointed(repeated_lines(docs, doc_id=doc_id, text=text, width=width, alike=alike)).select(F.col("doc_id").alias(other), F.col("key").alias(other_key), F.col("lines").alias(numbers))
    marked = docs.withColumn(key, F.xxhash64(F.col(text))).withColumn(mine, F.col(doc_id).cast("long"))
    both = marked.join(_small(gone, 48, F.size(numbers), 4), F.col(mine).eqNullSafe(F.col(other)) & (F.col(key) == F.col(other_key)), "left")
    lines = F.split(F.col(text), "\n")
    rest = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(numbers)), lambda i: x[i]), "\n"))
    cleaned = F.when(F.col(numbers).isNull(), F.col(text)).otherwise(rest)
    columns = [cleaned.alias(c) if c == text else F.col(c) for c in docs.columns if c.lower() != "removed_lines"]
    return both.select(*columns, F.coalesce(numbers, F.array().cast("array<int>")).alias("removed_lines"))
