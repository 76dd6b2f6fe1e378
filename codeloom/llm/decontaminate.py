"""Benchmark decontamination by template windows, in DataFrame functions alone.

Numbers (with sign, separators, decimals and exponent, or as words of four languages), units after numbers and names (runs of capitalised words inside a sentence)
become one typed placeholder each, so a question with other values has the same template. A run of names ends at
a line break. Whether a capitalised word that begins a sentence is a name can't be told; where aligned tokens are compared, it
stands for any other such word, or for a name. Hashes of every window of ``WINDOW`` template tokens of whole
documents meet those of the benchmark. Windows of one document and item that lie at one offset belong
together. At every such offset the aligned tokens are compared exactly: ``MIN_TOKENS`` of them must be equal, or the whole of a
shorter item, and each value of the item must stand for one value of the document (slot consistency).

Items shorter than a window are matched as one window of their own length. A benchmark window with fewer than ``LITERALS`` words
fits almost any run of values, so it is met by the values themselves.

Cases: a null text has no tokens; items without tokens match nothing; a null id is a document like any other (its
row has a null id); equal rows share one result row; an item id that occurs twice counts as one item with
several texts; among several offsets of one item in one document the counts of the best are given; very long texts are matched whole; further columns
may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, without

WINDOW, MIN_TOKENS, LITERALS = 8, 13, 2
#: Benchmark windows, and places in documents to check, that may be broadcast (16 to 24 bytes each); more of them are joined by shuffle.
BROADCAST_WINDOWS, BROADCAST_PLACES = 2_000_000, 1_000_000

#: Fixed words for units, as they stand after a number.
UNITS = "km|kg|mg|cm|mm|ml|kwh|mph|kmh|gb|mb|ms|hz|khz|mhz|kw|ft|lb|lbs|oz|m|g|l|s|h|w|v|a|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|miles?|meters?|metres?|kilometers?|kilometres?|feet|inch|inches|yards?|grams?|kilograms?|tons?|tonnes?|liters?|litres?|gallons?|dollars?|euros?|cents?|pounds?|usd|eur|gbp|percent|degrees?|heures?|jours?|ans|mètres?|stunden?|tage?|jahre?|meter|horas?|días?|años?|metros?"
#: Fixed words for numbers, from two on.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil"
).split()
NAME, UNIT, NUMBER = "§", "¤", "0"
#: What a window's hash is made of.
TEMPLATE, VALUES = "template", "values"
#: Stand for a comma, a point and a sign inside a number's value.
COMMA, POINT, SIGN = "\ue000", "\ue001", "\ue002"
#: Stands before a capitalised word that begins a sentence.
START = "\ue003"
_START_RE = r"(?<![\p{L}\p{N}§¤])\p{Lu}\p{Ll}+"
_NAME_RE = r"(?<=[\p{L}§,;:][ \t\n\r])\p{Lu}\p{Ll}+"
_SIGN_RE = r"(?<![\p{L}\p{N}§¤])[-−](?=[0-9])"
_EXPONENT_RE = "(?<=[0-9][eE])[-−](?=[0-9])"
# repeated groups are possessive: Java's greedy ones go one call deeper for each repeat, and a run of some thousand overflows the stack, which ends the executor
_MORE_NAMES_RE = r"(?:[ \t]\p{Lu}\p{Ll}++)*+"
_NUMBER_RE = rf"(?:{_SIGN_RE})?[0-9]++(?:[.,][0-9]++)*+(?:[eE][-+−]?[0-9]+)?"
_VALUE_RE = f"{SIGN}?[0-9]++(?:[{COMMA}{POINT}][0-9]++)*+(?:e{SIGN}?[0-9]+)?"
_UNIT_RE = rf"([0-9]) ?((?i:{UNITS}))([^\p{{L}}\p{{N}}]|$)"
_SPLIT_RE = rf"[^\p{{L}}\p{{N}}§¤{COMMA}{POINT}{SIGN}{START}]+"


def _split(marked: Column) -> Column:
    return F.array_remove(F.split(F.lower(marked), _SPLIT_RE), "")


def _plain(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), COMMA + POINT + SIGN + START, "    ")


def template_tokens(text: Column) -> Column:
    """Lower-cased tokens with placeholders."""
    t = F.regexp_replace(_plain(text), _NAME_RE + _MORE_NAMES_RE, NAME)
    t = F.regexp_replace(t, _UNIT_RE, f"$1 {UNIT}$3")
    return F.transform(_split(F.regexp_replace(t, _NUMBER_RE, NUMBER)), lambda x: F.when(x.isin(*NUMBER_WORDS), NUMBER).otherwise(x))


def slot_tokens(text: Column, starts: bool = False) -> Column:
    """The same tokens, with the values in their slots; with ``starts``, words that begin a sentence are marked."""
    t = F.regexp_replace(_plain(text), _NAME_RE, f"{NAME}$0")
    t = F.regexp_replace(t, rf"({NAME}\p{{Lu}}\p{{Ll}}+)[ \t](?={NAME}\p{{Lu}})", "$1")
    t = F.regexp_replace(t, _UNIT_RE, f"$1 {UNIT}$2$3")
    t = F.regexp_replace(t, _START_RE, f"{START}$0") if starts else t
    t = F.regexp_replace(F.regexp_replace(t, _SIGN_RE, SIGN), _EXPONENT_RE, SIGN)
    t = F.regexp_replace(t, r"(?<=[0-9][eE])\+(?=[0-9])", "")
    return _split(F.regexp_replace(F.regexp_replace(t, "(?<=[0-9]),(?=[0-9])", COMMA), r"(?<=[0-9])\.(?=[0-9])", POINT))


def _bare(token: Column) -> Column:
    return F.translate(token, START, "")


def canonical(token: Column) -> Column:
    """The template token of a slot token."""
    word = _bare(token)
    return F.when(token.startswith(NAME), F.regexp_replace(token, r"(?:§\p{Ll}++)++", NAME)).when(token.startswith(UNIT), F.lit(UNIT)).when(
        word.isin(*NUMBER_WORDS), F.lit(NUMBER)).otherwise(F.regexp_replace(word, _VALUE_RE, NUMBER))


def is_slot(token: Column) -> Column:
    return token.startswith(NAME) | token.startswith(UNIT) | token.rlike("[0-9]") | _bare(token).isin(*NUMBER_WORDS)


def agree(mine: Column, theirs: Column) -> Column:
    """Whether two aligned slot tokens are equal but for values; a word that begins a sentence agrees with any other, and with a name."""
    start, name = lambda t: t.startswith(START), lambda t: t.startswith(NAME)
    return (canonical(mine) == canonical(theirs)) | start(mine) & (start(theirs) | name(theirs)) | name(mine) & start(theirs)


def window_keys(tokens: Column, sizes: list[int], tag: str) -> Column:
    """(at, key) of every window of each of the sizes: a hash of its tokens, its size by its length, and ``tag``. The array is bound once, as a lambda's variable."""
    own = lambda a, w: F.when(F.size(a) >= w, F.transform(F.sequence(F.lit(0), F.size(a) - w),
        lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(tag), F.slice(a, i + 1, w)).alias("key")))).otherwise(
            F.array().cast("array<struct<at:int,key:bigint>>"))
    return F.element_at(F.transform(F.array(tokens), lambda a: F.concat(*[own(a, w) for w in sizes])), 1)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """One row for each document and item it contains: id, item, n_tokens (equal aligned tokens), n_slots, ``row_key``."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    own = own.withColumn("row_key", F.xxhash64("id", "body"))
    items = benchmark.select(F.col(item_col).alias("item"), slot_tokens(F.col(item_text), True).alias("item_slots"), slot_tokens(F.col(item_text)).alias("item_values"),
        template_tokens(F.col(item_text)).alias("item_tokens"))
    items = items.withColumn("size", F.size("item_tokens")).filter(F.col("size") > 0).distinct()
    items = items.withColumn("item_key", F.xxhash64("item", "item_slots"))
    items = cut(items, "items")
    length = F.least(F.col("size"), F.lit(window))
    starts = items.select("item_key", "item_tokens", "item_values", length.alias("w"), F.explode(F.sequence(F.lit(0), F.col("size") - length)).alias("item_at"))
    part = lambda c: F.slice(c, F.col("item_at") + 1, F.col("w"))
    literal = F.size(F.filter(part("item_tokens"), lambda t: ~t.isin(NAME, UNIT, NUMBER))) >= LITERALS
    kind = F.when(literal, TEMPLATE).otherwise(VALUES)
    keys = starts.select("item_key", "item_at", "w", kind.alias("kind"), F.when(literal, F.xxhash64(F.lit(TEMPLATE), part("item_tokens"))).otherwise(
        F.xxhash64(F.lit(VALUES), part("item_values"))).alias("key"))
    keys = cut(keys, "item-windows")
    # at most ``window`` sizes of each kind; a document's tokens are made once for all of them
    wanted = [(r.kind, r.w) for r in keys.groupBy("kind", "w").count().orderBy("kind", "w").collect()]
    found = None
    if wanted:
        lists = [window_keys(make(F.col("body")), [w for k, w in wanted if k == tag], tag) for tag,
            make in ((TEMPLATE, template_tokens), (VALUES, slot_tokens)) if any(k == tag for k, _ in wanted)]
        rows = own.select("row_key", F.inline(F.concat(*lists)))
        keys = keys.select("item_key", "item_at", "key")
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_WINDOWS else keys
        found = rows.join(keys, "key").select("row_key", "item_key", (F.col("at") - F.col("item_at")).alias("offset"))
    schema = f"id {own.schema['id'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, n_tokens int, n_slots int, row_key long"
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    found = cut(found.distinct(), "aligned")
    # a document's tokens are made once, whatever the number of its offsets
    places = found.groupBy("row_key").agg(F.collect_list(F.struct("item_key", "offset")).alias("places"))
    places = F.broadcast(places) if found.count() <= BROADCAST_PLACES else places
    aligned = own.join(places, "row_key").select("row_key", "id", slot_tokens(F.col("body"), True).alias("doc_slots"), "places")
    aligned = aligned.select("row_key", "id", "doc_slots", F.inline("places")).join(items, "item_key")

    def aligned_pairs(slots: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda j: (j + F.col("offset") >= 0) & (j + F.col("offset") < F.size(slots)))
        pair = F.transform(places, lambda j: F.struct(F.get("item_slots", j).alias("mine"), F.get(slots, (j + F.col("offset")).cast("int")).alias("theirs")))
        return F.filter(pair, lambda p: agree(p["mine"], p["theirs"]))

    pairs = F.element_at(F.transform(F.array(F.col("doc_slots")), aligned_pairs), 1)
    both = aligned.select("row_key", "id", "item", "size", pairs.alias("pairs"))
    slots = F.array_distinct(F.filter("pairs", lambda p: is_slot(p["mine"])))
    both = both.select("row_key", "id", "item", "size", F.size("pairs").alias("n_tokens"), slots.alias("slots"))
    one_value = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda p: p["mine"])))
    good = both.filter(one_value & (F.col("n_tokens") >= F.least(F.col("size"), F.lit(min_tokens))))
    return good.groupBy("row_key", "id", "item").agg(F.max("n_tokens").alias("n_tokens"), F.max(F.size("slots")).alias("n_slots")).select("id",
        "item", "n_tokens", "n_slots", "row_key")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", **columns: str) -> DataFrame:
    """(document, item) pairs with the number of equal tokens and of distinct slots."""
    found = matches(docs, benchmark, id_col=id_col, item_col=item_col, **columns)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_tokens", "n_slots")


def keep_unseen(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the documents that contain no benchmark item."""
    gone = cut(matches(docs, benchmark, id_col=id_col, text_col=text_col).select("row_key").distinct(), "contaminated")
    return without(docs, gone, [F.xxhash64(F.col(id_col), F.col(text_col))], gone.count() <= BROADCAST_PLACES)
