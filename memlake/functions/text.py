"""Text and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Distinct [a-z0-9]+ of the lower-cased text, in order of first occurrence."""
    return F.array_distinct(all_tokens(text))


def all_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def chunk_id(source_id: Column, level: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("chk_"), F.substring(sha(F.concat_ws(":", source_id, level, ordinal.cast("string"))), 1, 16))


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), sha(text))


def fingerprint(name: Column) -> Column:
    """A slug; over 48 characters its first 40 and seven hex digits of its hash."""
    slug = F.regexp_replace(name, r"[:/\\ ]", "-")
    return F.when(F.length(slug) > 48, F.concat(F.substring(slug, 1, 40), F.lit("-"), F.substring(sha(name), 1, 7))).otherwise(slug)


def memory_key(scope: Column, category: Column, fingerprint_: Column, hash_: Column) -> Column:
    return F.concat_ws(":", F.lit("memory"), scope, category, fingerprint_, hash_)


def canonical_url(url: Column) -> Column:
    """Host and path in lower case: no port, query, fragment, final slash; git@ forms lose ".git"."""
    at = F.regexp_extract(url, r"^git@([^:]+):(.*?)(\.git)?/*$", 1), F.regexp_extract(url, r"^git@([^:]+):(.*?)(\.git)?/*$", 2)
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:]*)(?::\d+)?([^?#]*)"
    plain = F.concat(F.lower(F.regexp_extract(url, parts, 1)), F.lit("://"), F.lower(F.regexp_extract(url, parts, 2)), F.regexp_replace(F.lower(F.regexp_extract(url, parts, 3)), "/+$", ""))
    return F.when(url.startswith("git@"), F.lower(F.concat(F.lit("https://"), at[0], F.lit("/"), at[1]))).when(url.rlike(parts), plain).otherwise(F.lower(url))


def valid_scope_key(key: Column) -> Column:
    return key.isNull() | key.rlike("^(repo|project|campaign):.+$")


def email_slug(email: Column) -> Column:
    local = F.lower(F.substring_index(email, "@", 1))
    return F.trim(F.lit("-"), F.regexp_replace(local, "[^a-z0-9]+", "-"))


def plausible_label(label: Column) -> Column:
    """2 to 30 letters (German ones too), digits, "_" or "-"; in 5 or more no character above 60 %."""
    x = F.lower(F.trim(label))
    letters = F.split(x, "")
    top = F.array_max(F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda d: d == c))))
    return F.coalesce(x.rlike("^[a-zäöüß0-9_-]{2,30}$") & ((F.length(x) < 5) | (top <= F.length(x) * 0.6)), F.lit(False))


PATH_RULES = (
    ("tests", ("test_", "_test\\.", "/tests/", "conftest")),
    ("api", ("/api/", "/routes/", "/controllers/", "router")),
    ("data_access", ("/model/", "/models/", "/db/", "/migration", "repositor")),
    ("auth", ("/security", "/guards?/", "/policies?", "/auth")),
    ("domain", ("/service", "/domain", "/usecase", "/business")),
    ("middleware", ("/middleware", "/pipeline")),
    ("config", ("config.*\\.(?:py|yaml|yml|env)", "settings\\.", "constants\\.")),
    ("utils", ("/util/", "/utils/", "/helper/", "/helpers/", "/tool/", "/tools/")),
    ("caching", ("/cache", "redis", "memcache")),
    ("logging", ("/log", "monitor", "metric", "trace")),
)


def path_category(path: Column) -> Column:
    """The first rule that a path meets, or null."""
    out = F.lit(None).cast("string")
    for name, parts in reversed(PATH_RULES):
        out = F.when(path.rlike("(?i)" + "|".join(parts)), name).otherwise(out)
    return out


def test_path(path: Column) -> Column:
    folders, python, other = r"(^|/)(test|tests|spec|__tests__)/", r"test_[^/]+\.py", r"[^/]+_test\.(py|js|ts)"
    return F.coalesce(path.rlike("(?i)" + "|".join((folders, python, other, r"[^/]+\.(test|spec)\.[a-z0-9]+", "conftest"))), F.lit(False))


#: Patterns of a line of code, joined into one so that each line is matched once.
CODE_LINE = "|".join(
    (
        r"^\s*<\?php\b",
        r"^\s*(?:trait|interface|class|public|protected|private|function|def)\s+\w",
        r"^\s*(?:namespace|use|from|import)\s+[\w\\]+",
        r"^\s*(\+\+\+|---)\s+[ab]/",
        r"^\s*@@\s+-[0-9]+,[0-9]+\s+\+[0-9]+,[0-9]+\s+@@",
        r"^\s*[0-9]+→",
        r"^\s*[\}\]\)]\s*[,;]?\s*$",
        r"^\s*(//|#\s*include\b)",
    )
)
FENCE = r"(?s)```[^\n]*\n.*?\n```"


def code_density(text: Column) -> Column:
    """Share of characters in fenced blocks or lines of code."""
    rest = F.regexp_replace(text, FENCE, "")
    lines = F.split(rest, "\n", -1)
    own = F.aggregate(F.transform(lines, lambda x, i: F.when(x.rlike(CODE_LINE), F.length(x) + F.when(i < F.size(lines) - 1, 1).otherwise(0)).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(text) == 0, 0.0).otherwise(F.least(F.lit(1.0), (F.length(text) - F.length(rest) + own) / F.length(text)))


def prose_words(text: Column) -> Column:
    """Words of three letters or more outside code."""
    lines = F.filter(F.split(F.regexp_replace(text, FENCE, ""), "\n", -1), lambda x: ~x.rlike(CODE_LINE))
    return F.size(F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(r"(?<![A-Za-z0-9_äöüÄÖÜß])[A-Za-zäöüÄÖÜß]{3,}(?![A-Za-z0-9_äöüÄÖÜß])"), F.lit(0)))


def skip_reason(text: Column, source_type: Column) -> Column:
    """Why a chunk isn't worth keeping, or null; only conversation summaries are judged."""
    diff = text.rlike(r"(?m)^@@\s+-[0-9]+,[0-9]+\s+\+[0-9]+,[0-9]+\s+@@") | text.rlike(r"(?m)^---\s+[ab]/.*\n\+\+\+\s+[ab]/")
    density = code_density(text)
    code = ((density > 0.6) & (prose_words(text) < 40)) | (density > 0.85)
    return F.when(source_type != "conversation_summary", None).when(F.length(text) < 80, "too_short").when(diff, "diff_output").when(code, "code_density")


def urgency(hook_type: Column, conclusion: Column, severity: Column) -> Column:
    """red, yellow, green or grey of a hook event."""
    kind, end, how = F.lower(F.coalesce(hook_type, F.lit(""))), F.lower(F.coalesce(conclusion, F.lit(""))), F.lower(F.coalesce(severity, F.lit("")))
    security = F.when(how.isin("low", "medium", "moderate"), "yellow").otherwise("red")
    ci = F.when(end.isin("timed_out", "startup_failure", "failure"), "red").when(end == "success", "green").when(end == "skipped", "grey").otherwise("yellow")
    return F.when(kind.isin("repo_dependabot", "repo_security"), security).when(kind == "repo_ci", ci).when(kind == "repo_issue", "yellow").otherwise("grey")
