"""Column functions of the string analysis: predicates on strings, references, similarity. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that results depend on ----
COMPLEX_STARTS = ("arn:", "http://", "https://", "jdbc:", "postgres:", "mysql:", "mongodb:", "redis:")
CANDIDATES = {
    "ARN": r"(arn:aws:[a-z0-9-]+:[a-z0-9-]*:(?:\d{12})?:[a-zA-Z0-9-_\/]+)",
    "URL": r'((?:https?|ftp|jdbc|postgres|mysql|redis|mongodb):\/\/[^\s/$.?#].[^\s"]+)',
    "IP": r"(\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b)",
    "DOMAIN": r"([a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+)",
}
CONFIG_SYNTAX = r"^(rule|var|module|data|resource|aws|local|output|provider|terraform)[\._]"
IGNORED_KEYS = ("description", "note", "comment", "readme", "usage", "version", "parent_id", "id", "type", "source", "ingress", "egress")
IGNORED_VALUES = ("module.root", "root", "terraform", "provider", "aws", "0.0.0.0", "127.0.0.1", "localhost", "true", "false", "null")
IGNORED_ENDINGS = ("local", "internal", "tf", "json", "yaml", "tpl", "root", "backend", "partner", "allow", "deny")
BRACED = r"\$\{\s*(var|local|module|data)\.([A-Za-z0-9_-]+)(?:\.[A-Za-z0-9_.-]+)?\s*\}"
BARE = r"(?<![\w.$-])(?<!\$\{\s{0,50})(var|local)\.([A-Za-z0-9_-]+)"
# ---- end of fixed values ----

WORD = "[A-Za-z0-9_]"


def path_id(path: Column) -> Column:
    """P-4: an absolute path as a project's identifier."""
    return F.regexp_replace(F.regexp_replace(path, "^/", ""), "/", ".")


def type_of(label: Column) -> Column:
    """SC-6: what stands before the first dot."""
    return F.substring_index(label, ".", 1)


def name_of(label: Column) -> Column:
    """SC-6: what stands behind the first dot; empty without a dot."""
    at = F.instr(label, ".")
    return F.when(at > 0, F.substring(label, at + 1, F.length(label))).otherwise(F.lit(""))


def is_identifier(s: Column) -> Column:
    """F-11: may be the plain name of something: no ARN, URL, mail address, IPv4 address or open template."""
    n = F.length(s)
    return F.coalesce((n >= 2) & (n <= 100) & ~s.startswith("arn:") & ~s.startswith("http://") & ~s.startswith("https://") & ~(s.contains("@") & s.contains(".")) & ~s.rlike(r"^\d+\.\d+\.\d+\.\d+") & ~s.contains("${"), F.lit(False))


def is_complex(s: Column) -> Column:
    """F-12: may hold a name within: a known scheme, a service host, or something like a domain."""
    low = F.lower(s)
    scheme = F.lit(False)
    for start in COMPLEX_STARTS:
        scheme = scheme | low.startswith(start)
    domain = s.contains(".") & ~s.contains(" ") & ~s.rlike(r"^\d+(\.\d+)+$") & low.rlike(r"[a-z0-9][a-z0-9-]*\.[a-z]{2,}")
    return F.coalesce((F.length(s) >= 5) & (scheme | low.contains(".amazonaws.com") | low.contains(".internal") | domain), F.lit(False))


def is_fuzzy_value(s: Column) -> Column:
    """F-13."""
    return F.coalesce((F.length(s) >= 4) & ~s.contains("${") & ~s.contains("arn:") & ~s.contains("http"), F.lit(False))


def is_resolved_name(s: Column, least: int) -> Column:
    """F-14: fit for a symbol table."""
    return F.coalesce((F.length(s) >= least) & ~s.contains("${") & ~s.contains("var."), F.lit(False))


def has_reference(s: Column) -> Column:
    """E-1."""
    return F.coalesce(s.rlike(BRACED) | s.rlike(BARE), F.lit(False))


def references(s: Column) -> Column:
    """E-3: array of (raw, scope, name), each raw form once. raw is the text that stands for the reference."""

    def found(pattern: str) -> Column:
        every = [F.regexp_extract_all(s, F.lit(pattern), F.lit(g)) for g in (0, 1, 2)]
        return F.transform(F.arrays_zip(*(e.alias(k) for e, k in zip(every, "rsn", strict=True))), lambda x: F.struct(x["r"].alias("raw"), x["s"].alias("scope"), x["n"].alias("name")))

    return F.array_distinct(F.concat(found(BRACED), found(BARE)))


def substituted(s: Column, values: Column) -> Column:
    """E-4: s with each raw form in values (array of (raw, value)) replaced; unknown ones stay as they are."""

    def put(text: Column, v: Column) -> Column:
        bare = F.concat(F.lit(r"(?<![\w.$-])(?<!\$\{\s{0,50})\Q"), v["raw"], F.lit(r"\E(?![\w-])"))
        quoted = F.regexp_replace(v["value"], r"([\\$])", r"\\$1")
        return F.when(v["value"].isNull(), text).when(v["raw"].startswith("$"), F.replace(text, v["raw"], v["value"])).otherwise(F.regexp_replace(text, bare, quoted))

    return F.aggregate(F.coalesce(values, F.array().cast("array<struct<raw:string,value:string>>")), s, put)


BITS = 62  # characters whose marks fit a long with room for one addition


def _common_by_bits(a: Column, b: Column) -> Column:
    """common_length for an `a` of at most BITS characters: a row of its table is a number, a step one addition."""
    chars, none = F.split(a, ""), F.lit(0).cast("long")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    marks = F.transform(F.array_distinct(chars), lambda c: F.struct(c, F.aggregate(F.transform(chars, lambda x, i: F.when(x == c, bit(i)).otherwise(none)), none, lambda m, x: m + x)))
    masks, full = F.map_from_entries(marks), bit(F.length(a)) - 1

    def step(row: Column, x: Column) -> Column:
        met = row.bitwiseAND(F.coalesce(F.try_element_at(masks, x), none))
        return (row + met).bitwiseOR(row - met).bitwiseAND(full)

    return F.length(a) - F.bit_count(F.aggregate(F.split(b, ""), full, step))


def _common_by_rows(a: Column, b: Column) -> Column:
    chars_a, chars_b = F.split(a, ""), F.split(b, "")
    columns = F.sequence(F.lit(1), F.size(chars_b))

    def row(before: Column, x: Column) -> Column:
        def cell(now: Column, j: Column) -> Column:
            met = F.element_at(before, j) + F.when(F.element_at(chars_b, j) == x, 1).otherwise(0)
            return F.concat(now, F.array(F.greatest(F.element_at(before, j + 1), F.element_at(now, -1), met)))

        return F.aggregate(columns, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(chars_a, F.array_repeat(F.lit(0), F.size(chars_b) + 1), row), -1)


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(F.length(a) <= BITS, _common_by_bits(a, b)).when(F.length(b) <= BITS, _common_by_bits(b, a)).otherwise(_common_by_rows(a, b))


def indel_ratio(a: Column, b: Column) -> Column:
    """E-9: 2 x common / (length + length); 1 for two empty strings."""
    n = F.length(a) + F.length(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * common_length(a, b) / n)


def may_be_near(a: Column, b: Column, threshold: float) -> Column:
    """A cheap test that no pair with the ratio fails: edit distance is at most the number of insertions and deletions."""
    most = F.floor((1 - threshold) * (F.length(a) + F.length(b)) + F.lit(1e-9))
    return F.call_function("levenshtein", a, b, most.cast("int")) >= 0


def under_ignored(key: Column, ignored=IGNORED_KEYS) -> Column:
    """F-15: whether any part of a flattened key is ignored, whatever its case and list positions."""
    parts = F.split(F.regexp_replace(F.lower(key), r"\[\d+\]", ""), r"\.")
    return F.coalesce(F.exists(parts, lambda x: x.isin(*ignored)), F.lit(False)) if ignored else F.lit(False)


def candidate(value: Column) -> Column:
    """E-16, F-15: struct (value, kind) of the outside entity that a string names, or null."""
    v = F.trim(value, F.lit("\",' "))
    first = {k: F.nullif(F.regexp_extract(v, p, 1), F.lit("")) for k, p in CANDIDATES.items()}
    pair = lambda x, kind: F.struct(x.alias("value"), F.lit(kind).alias("kind"))
    none = F.lit(None).cast("struct<value:string,kind:string>")
    ip, domain = first["IP"], first["DOMAIN"]
    named = (F.length(v) < 100) & ~v.contains(" ") & domain.isNotNull() & ~F.substring_index(domain, ".", -1).isin(*IGNORED_ENDINGS)
    out_of_question = value.isNull() | (F.length(value) < 5) | value.contains("${") | v.isin(*IGNORED_VALUES) | F.lower(v).rlike(CONFIG_SYNTAX)
    return (
        F.when(out_of_question, none)
        .when(first["ARN"].isNotNull(), pair(first["ARN"], "ARN"))
        .when(first["URL"].isNotNull(), pair(first["URL"], "URL"))
        .when(ip.isNotNull(), F.when(~ip.startswith("0.") & (ip != "127.0.0.1"), pair(ip, "IP")).otherwise(none))
        .when(named, pair(domain, "DOMAIN"))
        .otherwise(none)
    )

