"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 1, line) for every line of every text."""
    return df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("at", "line")).select(
        id_col, (F.col("at") + 1).alias("line_no"), "line"
    )


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def estimate_tokens(x: Column) -> Column:
    """Tokens of a text, at 3.6 characters each, rounded up."""
    return F.ceil(F.length(x) / 3.6)


def count_lines(x: Column) -> Column:
    """Line breaks and one; none in an empty text."""
    return F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1)


def slice_lines(x: Column, first: Column | int, last: Column | int) -> Column:
    """Lines first to last, from 1 and both included, as far as there are any."""
    first, last = (F.lit(v) if isinstance(v, int) else v for v in (first, last))
    a = F.greatest(first, F.lit(1))
    return F.array_join(F.slice(F.split(x, "\n", -1), a, F.greatest(last - a + 1, F.lit(0))), "\n")


def line_of_offset(x: Column, offset: Column) -> Column:
    """The line, from 1, that an offset (from 0) is on."""
    head = F.substring(x, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def truncate(x: Column, n: int) -> Column:
    """At most n characters, with a note of how many are missing."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("\n… ["), (F.length(x) - n).cast("string"), F.lit(" more characters]"))).otherwise(x)


def split_identifier(x: Column) -> Column:
    """The lower-case words of a camel, Pascal or snake case name."""
    a = F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")
    b = F.regexp_replace(a, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.filter(F.split(b, "[^A-Za-z0-9]+"), lambda w: w != ""), F.lower)


def lexical_tokens(x: Column) -> Column:
    """Lower-case words of two characters or more, each followed by its own parts of two or more."""
    words = F.filter(F.split(x, "[^A-Za-z0-9_$]+"), lambda w: F.length(w) > 1)
    parts = lambda w: F.filter(split_identifier(w), lambda p: (F.length(p) > 1) & (p != F.lower(w)))
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(F.lower(w)), parts(w))))


def fnv1a(x: Column) -> Column:
    """The 32-bit FNV-1a hash over characters."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.aggregate(chars, F.lit(2166136261).cast("long"), step)


def trigrams(x: Column) -> Column:
    """The distinct trigrams of a text's words, each with two spaces before it and one after (X11)."""
    words = F.filter(F.split(F.lower(x), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: p.substr(i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two texts (arrays by ``trigrams``); 0 for two empty ones (X11)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def entropy(x: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty text."""
    def of(chars: Column) -> Column:
        share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / F.size(chars)
        return F.aggregate(F.transform(F.array_distinct(chars), lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda s, v: s + v)

    return F.when(F.length(x) == 0, 0.0).otherwise(let(F.filter(F.split(x, ""), lambda c: c != ""), of))


def number_lines(x: Column, first: Column | int = 1) -> Column:
    """Each line behind its number, five wide."""
    start = F.lit(first) if isinstance(first, int) else first
    lines = F.transform(F.split(x, "\n", -1), lambda line, i: F.concat(F.lpad((i + start).cast("string"), 5, " "), F.lit(" | "), line))
    return F.array_join(lines, "\n")


def one_line(x: Column, n: int | None = None) -> Column:
    """White space to single spaces, and an ellipsis after n characters."""
    flat = F.trim(F.regexp_replace(x, "\\s+", " "))
    return flat if n is None else F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…"))).otherwise(flat)


def diagram_label(x: Column, n: int = 40) -> Column:
    """A text fit for a diagram's label: no quotes, brackets or breaks, at most n characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(x, "[\"'`<>{}()\\[\\]|]", " "), "\\s+", " ")), 1, n)


def cyclomatic(x: Column) -> Column:
    """One and a point for each branching word or operator."""
    return 1 + F.regexp_count(x, F.lit("\\b(?:if|for|while|case|catch|elif|except|when)\\b|&&|\\|\\||\\?(?![.?:])"))


def normalise_code(x: Column) -> Column:
    """Code without comments and white space differences, literals replaced by S and N."""
    x = F.regexp_replace(x, "(?s)/\\*.*?\\*/", " ")
    x = F.regexp_replace(x, "(?m)(//|#).*$", " ")
    x = F.regexp_replace(x, "\"(?:\\\\.|[^\"\\\\\\n])*\"|'(?:\\\\.|[^'\\\\\\n])*'|`(?:\\\\.|[^`\\\\])*`", "\"S\"")
    x = F.regexp_replace(x, "\\b[0-9][0-9a-fA-FxX_.]*\\b", "N")
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def code_tokens(x: Column) -> Column:
    """Identifiers and single marks."""
    return F.regexp_extract_all(x, F.lit("[A-Za-z_$][\\w$]*|[^\\s\\w]"), F.lit(0))


def shingles(tokens: Column, k: int = 5, most: int | None = 600) -> Column:
    """Hashes of the distinct runs of k tokens, the first ``most``."""
    def of(t: Column) -> Column:
        # the tokens of a run are hashed where they are: slices and joined texts would be made anew for each
        runs = F.transform(F.sequence(F.lit(0), F.size(t) - k), lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(k)]))
        return F.when(F.size(t) >= k, F.array_distinct(runs)).otherwise(F.expr("cast(array() as array<bigint>)"))

    all_ = let(tokens, of)  # the tokens are asked for at every place
    return all_ if most is None else F.slice(all_, 1, most)


def semantic_header(path: Column, language: Column, symbol: Column, content: Column, n: int = 12_000) -> Column:
    """The text that stands for a chunk where it is embedded."""
    head = F.concat_ws("\n", F.concat(F.lit("File: "), path), F.concat(F.lit("Language: "), language), F.concat(F.lit("Symbol: "), symbol))
    return F.substring(F.concat(head, F.lit("\n\n"), content), 1, n)


def citations(x: Column) -> Column:
    """Citations in prose as structs (path, first, last): a path with an extension, then :l, :l-l or (l)."""
    pattern = "((?:[\\w.@-]+/)*[\\w@-][\\w.@-]*\\.[A-Za-z][A-Za-z0-9]{0,7})(?::([0-9]+)(?:-([0-9]+))?|\\(([0-9]+)\\))?"
    parts = [F.regexp_extract_all(x, F.lit(pattern), F.lit(i)) for i in range(1, 5)]
    zipped = F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)])
    rows = F.transform(
        zipped,
        lambda z: F.struct(
            z["g0"].alias("path"), F.coalesce(F.expr("null").cast("int"), F.nullif(z["g1"], F.lit("")).cast("int"), F.nullif(z["g3"], F.lit("")).cast("int")).alias("first"),
            F.nullif(z["g2"], F.lit("")).cast("int").alias("last"),
        ),
    )
    keep = lambda r: ~r["path"].rlike("^(?:[vV]?[0-9.]+[a-z0-9]*|e\\.g|i\\.e|etc|vs)$") & (F.contains(r["path"], F.lit("/")) | r["first"].isNotNull())
    return F.array_distinct(F.filter(rows, keep))


def check_id_tail(x: Column) -> Column:
    """A check id without the path of the rule file it was loaded from."""
    return F.regexp_replace(x, "^(?:.*\\.)?(?=(?:[a-z]+)\\.(?:lang|security|best-practice|correctness|audit)\\b)", "")


#: 10 lines of 160 characters, 4 and 8 characters of substance, 3 lines where none tells (in ``digest_lines``).
#: What makes a line worth a look, our own list: it takes input, reaches storage, a process, the network or the page, or handles a secret.
TELLING = (
    "(?i)\\b(?:request|req|params|headers|cookies?|form|argv|stdin)\\b|\\b(?:select|insert|update|delete)\\s|\\b(?:query|execute|cursor|eval|exec|spawn|system|popen)\\s*\\("
    "|\\b(?:fetch|urlopen|connect|redirect|open|readFile|writeFile)\\s*\\(|https?://|innerHTML|localStorage"
    "|passw|secret|token|credential|session|login|crypt|\\bhash|\\bsign|\\bverify|deserial|pickle"
)
BRINGS_IN = "^\\s*(?:import|from|package|using|use|#include|require)\\b|=\\s*require\\("


def digest_lines(content: Column, telling: str = TELLING, most: int = 10, width: int = 160) -> Column:
    """A file's ``most`` first telling lines behind their numbers; where there are none, its first three of substance.

    Lines that only bring in other files never count; shorter lines than 4 don't tell, than 8 or comments aren't of substance.
    """
    rows = F.transform(F.split(content, "\n", -1), lambda line, i: F.struct((i + 1).alias("n"), F.trim(F.regexp_replace(line, "^\\s+|\\s+$", "")).alias("t")))

    def pick(rows: Column) -> Column:
        own = F.filter(rows, lambda r: (F.length(r["t"]) >= 4) & ~r["t"].rlike(BRINGS_IN))
        told = F.slice(F.filter(own, lambda r: r["t"].rlike(telling)), 1, most)
        plain = F.slice(F.filter(own, lambda r: (F.length(r["t"]) >= 8) & ~r["t"].rlike("^(?://|\\*|#)")), 1, 3)
        return F.transform(F.when(F.size(told) > 0, told).otherwise(plain), lambda r: F.concat(F.lit("  "), r["n"].cast("string"), F.lit(": "), F.substring(r["t"], 1, width)))

    return F.array_join(let(rows, pick), "\n")


def human_bytes(x: Column) -> Column:
    """A size in B, KB, MB or GB."""
    unit = lambda p, u: F.concat(F.round(x / 1024**p, 1).cast("string"), F.lit(u))
    return F.when(x < 1024, F.concat(x.cast("string"), F.lit(" B"))).when(x < 1024**2, unit(1, " KB")).when(x < 1024**3, unit(2, " MB")).otherwise(unit(3, " GB"))
