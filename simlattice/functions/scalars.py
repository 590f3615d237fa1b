"""Scalar functions: every one builds a Column from Columns and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CODE, TOKENS

BASE, MODULUS = 131, 1_000_000_007


def _hash(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda h, t: (h * BASE + t.cast("long")) % MODULUS)


def window_hashes(seq: Column) -> Column:
    """Polynomial hashes of windows of 3 tokens, every 2 tokens. Fewer than 3: one hash of all; none: [0]; null: null."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(seq) - 3, F.lit(0)), F.lit(2))
    return F.when(F.size(seq) < 3, F.array(_hash(seq))).when(seq.isNotNull(), F.transform(starts, lambda i: _hash(F.slice(seq, i + 1, F.lit(3)))))


def encode(seq: Column) -> Column:
    """The tokens as a text of one character each, so that the built-in edit distance compares tokens. Codes up to a million."""

    def wide(t: Column) -> Column:
        code = t + 33
        code = F.when(code >= 0xD800, code + 0x800).otherwise(code)  # past the range that no character has
        return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")

    return F.array_join(F.transform(seq, lambda t: F.when(t < 94, F.char(t + 33)).otherwise(wide(t))), "")


def seq_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of encoded sequences; 1 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets (arrays without repeats); 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def geo_score(seq: Column, imp: Column, call: Column) -> Column:
    return F.cbrt(seq * imp * call)


def arith_score(seq: Column, imp: Column, call: Column) -> Column:
    return (seq + imp + call) / 3.0


def seq_key(seq: Column) -> Column:
    return F.array_join(F.transform(seq, lambda t: t.cast("string")), ",")


def shape_hash(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 16)


def token_name(code: Column, unknown: str = "T") -> Column:
    """The token's name; an unknown code is the code behind a prefix ('tok' where single tokens are listed)."""
    names = F.array(*[F.lit(x) for x in TOKENS])
    return F.when((code >= 0) & (code < len(TOKENS)), F.get(names, code)).otherwise(F.concat(F.lit(unknown), code.cast("string")))


def seq_string(seq: Column) -> Column:
    return F.array_join(F.transform(seq, lambda t: token_name(t)), " ")


def multiset_diff(a: Column, b: Column) -> Column:
    """What ``a`` has more often than ``b``, each as often as the difference, in order."""

    def more(x: Column) -> Column:
        return F.array_repeat(x, F.greatest(F.size(F.filter(a, lambda y: y == x)) - F.size(F.filter(b, lambda y: y == x)), F.lit(0)))

    return F.array_sort(F.flatten(F.transform(F.array_distinct(a), more)))


def token_diff(a: Column, b: Column) -> Column:
    """multiset_diff() of token codes, as sorted names."""
    return F.array_sort(F.transform(multiset_diff(a, b), lambda t: token_name(t, "tok")))


def list_diff(a: Column, b: Column) -> Column:
    """The items of ``a`` that ``b`` hasn't, sorted; those that ``a`` repeats are repeated."""
    return F.array_sort(F.filter(a, lambda x: ~F.array_contains(b, x)))


def short_import(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def short_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 3, path).otherwise(F.array_join(F.slice(parts, -3, 3), "/"))


def signed(value: Column) -> Column:
    return F.when(value > 0, F.format_string("+%.1f", value.cast("double"))).otherwise(F.format_string("%.1f", value.cast("double")))


def delta_text(added: Column, removed: Column) -> Column:
    parts = F.concat(F.transform(added, lambda x: F.concat(F.lit("+"), x)), F.transform(removed, lambda x: F.concat(F.lit("-"), x)))
    return F.when(F.size(parts) == 0, "—").otherwise(F.array_join(parts, "  "))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "0%").otherwise(F.concat(F.floor(part / whole * 100 + 0.5).cast("string"), F.lit("%")))


def fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))


def score_percent(score: Column) -> Column:
    return F.floor(score * 100).cast("int")


def confidence_bar(score: Column) -> Column:
    """The width of a bar that is full at a composite score of 8."""
    return F.least(F.greatest(F.floor(score / 8.0 * 100), F.lit(0)), F.lit(100)).cast("int")


def coherence_badge(value: Column) -> Column:
    return F.when(value >= 0.60, "green").when(value >= 0.40, "yellow").otherwise("red")


def score_badge(value: Column) -> Column:
    return F.when(value >= 0.75, "green").when(value >= 0.55, "yellow").otherwise("red")


def label_or_hash(label: Column, shape: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), shape)


def join_comma(items: Column) -> Column:
    return F.array_join(items, ", ")


def tier(std: Column, high: float = 0.05, medium: float = 0.12) -> Column:
    return F.when(std < high, "high").when(std < medium, "medium").otherwise("low")


def composite_score(size: Column, packages: Column, tier: Column, mean: Column, import_coherence: Column, call_coherence: Column) -> Column:
    """How much a cluster deserves attention; 0 for fewer than 2 members."""
    trust = F.when(tier == "high", 1.0).when(tier == "medium", 0.6).otherwise(0.3)
    score = F.log(size.cast("double")) * F.log1p(packages.cast("double")) * trust * mean * mean * (import_coherence + call_coherence) / 2.0
    return F.when(size <= 1, F.lit(0.0)).otherwise(score)


def admission_bar(threshold: float, n: Column, mean: Column, std: Column, k: float = 1.5, shrink: float = 5.0) -> Column:
    """The score from which an outsider counts as a near miss: the cluster's own spread, trusted by its size, above the threshold."""
    weight = n / (n + F.lit(shrink)) if shrink > 0 else F.lit(1.0)
    return F.lit(threshold) + weight * F.greatest(mean - F.lit(k) * std - F.lit(threshold), F.lit(0.0))


def sensitivity(delta: Column) -> Column:
    return F.when(delta < 0.02, "insensitive").when(delta < 0.05, "moderate").otherwise("critical")


def relative_path(path: Column) -> Column:
    """What follows the first '/repo/', or the whole path without one, less any slashes in front."""
    at = F.locate("/repo/", path)
    return F.ltrim(F.when(at > 0, F.substr(path, at + 6)).otherwise(path), F.lit("/"))


def browse_link(base: Column, tag: Column, path: Column) -> Column:
    """A link to the file at the tag; empty if the site or the file isn't known."""
    file = relative_path(path)
    return F.when((base == "") | (file == ""), "").otherwise(F.concat(base, F.lit("/blob/"), tag, F.lit("/"), file))


def release_line(tag: Column) -> Column:
    """(major, minor) at the start of a tag; (-1, -1) if there is none."""
    major, minor = [F.regexp_extract(tag, r"^v?(\d+)\.(\d+)", i) for i in (1, 2)]
    return F.struct(F.when(major == "", -1).otherwise(major.cast("int")).alias("major"), F.when(minor == "", -1).otherwise(minor.cast("int")).alias("minor"))


#: Words that tell what a commit was about; each pattern begins at a word.
COMMIT_KINDS = {
    "fix": ("(?:bug|correct|crash|deadlock|fix(?:ed|es)?|leak|panic|race|regress\\w*|CVE-\\d)", False),
    "refactor": ("(?:clean\\s?up|comment|gofmt|lint|refactor\\w*|rename|reorganiz\\w*|restructure|simplify|style|typo)", False),
    "feature": ("(?:add(?:ed|s)?|allow|enable|feat\\w*|implement\\w*|introduc\\w*|new|support)", True),
}


def commit_is(kind: str, subject: Column) -> Column:
    pattern, whole = COMMIT_KINDS[kind]
    return subject.rlike(f"(?i)\\b{pattern}" + ("\\b" if whole else ""))


def cwe_number(cwe: Column) -> Column:
    return F.regexp_replace(F.coalesce(cwe, F.lit("")), "[^0-9]", "")


def cwe_column(cwe: Column) -> Column:
    n, raw = cwe_number(cwe), F.trim(F.coalesce(cwe, F.lit("")))
    return F.when(n != "", F.concat(F.lit("CWE-"), n)).when(raw != "", raw).otherwise("CWE-?")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "High", 3).when(severity == "Medium", 2).when(severity == "Low", 1).otherwise(0)


def pass_band(name: Column) -> Column:
    return F.when(name == "A", "structural").when(name == "B", "semantic").when(name == "C", "systemic").otherwise("other")


def classify_call(is_selector: Column, receiver: Column, aliases: Column) -> Column:
    """The token of a call: a plain name, something of an imported package, or a method."""
    return F.when(~is_selector, CODE["CALL"]).when(F.array_contains(aliases, receiver), CODE["CALL_PKG"]).otherwise(CODE["CALL_METHOD"])


def alias_map(imports: Column) -> Column:
    """Import path by name, from structs (alias, path): the alias or the path's last segment; '_' and '.' name nothing."""
    named = F.filter(imports, lambda i: ~F.coalesce(i["alias"], F.lit("")).isin("_", "."))
    entries = F.transform(named, lambda i: F.struct(F.coalesce(F.nullif(i["alias"], F.lit("")), short_import(i["path"])).alias("k"), i["path"].alias("v")))
    return F.map_from_entries(F.array_distinct(entries))


def count_token(seq: Column, *names: str) -> Column:
    codes = [CODE[n] for n in names]
    return F.size(F.filter(seq, lambda t: t.isin(codes)))
