"""Text as column expressions: normal forms, digests, shingles, identifiers, repository and package keys.

Every function takes and returns Columns, so Catalyst fuses them with what surrounds them; nothing here runs Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no context, dropped before stemming.
CONTEXT_STOPWORDS = (
    "the", "and", "for", "with", "was", "were", "are", "this", "that", "from", "using", "used", "use", "into", "its", "our", "their",
    "which", "have", "has", "been", "also", "can", "these", "than", "then", "such", "each", "other", "more", "most", "based",
    "analysis", "data", "software", "version", "all",
)
#: Endings taken off a word of which four letters stay, first match wins.
STEM_ENDINGS = ("ments", "ment", "ings", "ing", "ers", "er", "ed", "es", "s")
#: Hosts whose first two path parts name a repository.
REPO_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "sourceforge.net")
_CR, _RUN = "﷐", "﷑"  # noncharacters, as placeholders


def normalize_v1(text: Column) -> Column:
    """CR and CRLF to LF, runs of blanks to one, no-break space to a blank, one or two LF to one and more to two."""
    return _normalize(text, 1)


def normalize_v2(text: Column) -> Column:
    """As normalize_v1, but two LF stay two."""
    return _normalize(text, 2)


def _normalize(text: Column, kept: int) -> Column:
    t = F.regexp_replace(text, "\r\n?", _CR)
    t = F.regexp_replace(t, "\n{3,}", _RUN)
    if kept == 1:
        t = F.regexp_replace(t, "\n\n?", "\n")
    t = F.replace(F.replace(t, F.lit(_RUN), F.lit("\n\n")), F.lit(_CR), F.lit("\n"))
    return F.replace(F.regexp_replace(t, "[ \t]+", " "), F.lit(" "), F.lit(" "))


def token_estimate(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4).cast("int")))


def collapse(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "\\s+", " "))


def exact_form(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed; compatibility forms of ASCII text are the text itself."""
    return collapse(F.lower(text))


def loose_form(text: Column) -> Column:
    """exact_form without anything but letters and digits; null if nothing stays."""
    return F.nullif(F.regexp_replace(exact_form(text), "(?U)[\\W_]+", ""), F.lit(""))


def text_digest(text: Column) -> Column:
    return F.sha2(collapse(text).cast("binary"), 256)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("(?U)(\\w+)"), F.lit(1))


def shingles(text: Column, width: int = 5) -> Column:
    """Distinct runs of `width` words as strings; none for shorter texts."""
    w = words(text)
    one = F.transform(F.array(w), lambda x: F.when(F.size(x) < width, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(x) - width + 1), lambda i: F.array_join(F.slice(x, i, width), " ")))))
    return one[0]


def pypi_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def package_id(ecosystem: Column, name: Column) -> Column:
    return F.when(ecosystem == "pypi", pypi_name(name)).otherwise(F.lower(F.btrim(name)))


def host_and_parts(url: Column) -> tuple[Column, Column]:
    """Lower-case host without www., and decoded path parts; accepts git+ and git@host:path forms and a missing scheme."""
    u = F.regexp_replace(F.regexp_replace(F.btrim(url), "^git\\+", ""), "^git@([^:]+):", "https://$1/")
    u = F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("https://"), u))
    authority = F.regexp_extract(u, "^[^:]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), "^.*@|:[0-9]*$", ""), "^www\\.", "")
    path = F.regexp_extract(u, "^[^:]*://[^/?#]*([^?#]*)", 1)
    return host, F.transform(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p))


def repo_key(url: Column) -> Column:
    """host/owner/name of a repository url on a known host; null otherwise."""
    host, parts = host_and_parts(url)
    dash = F.array_position(parts, "-")
    cut = F.when((host == "gitlab.com") & (dash > 0), F.slice(parts, 1, F.greatest(dash - 1, F.lit(0)).cast("int"))).when(host == "gitlab.com", parts).otherwise(F.slice(parts, 1, 2))
    n = F.size(cut)
    named = F.transform(cut, lambda p, i: F.lower(F.when(i == n - 1, F.regexp_replace(p, "\\.git$", "")).otherwise(p)))
    forge = F.when((F.size(parts) >= 2) & parts[0].isin("projects", "p"), F.concat(F.lit("sourceforge.net/"), F.lower(F.get(parts, F.lit(1)))))
    return F.when(host == "sourceforge.net", forge).when(host.isin(*REPO_HOSTS) & (n >= 2), F.concat_ws("/", host, named))


def url_package(url: Column) -> Column:
    """struct(ecosystem, package) of a package index url; null otherwise."""
    host, parts = host_and_parts(url)
    target = F.concat_ws("/", host, parts)
    pypi = F.regexp_extract(target, "^(?:pypi\\.org/project|pypi\\.python\\.org/pypi)/([^/]+)", 1)
    cran = F.regexp_extract(target, "^cran\\.(?:r-project\\.org|rstudio\\.com)/(?:package=|web/packages/)([^/]+)", 1)
    plain = F.regexp_extract(target, "^bioconductor\\.org/packages/([^/]+)", 1)
    staged = F.regexp_extract(target, "^bioconductor\\.org/packages/(?:release|devel|[0-9]+\\.[0-9]+)/.*?\\b(?:html|vignettes|manuals|news)/([^/]+)", 1)
    bioc = F.when(plain.rlike("^(release|devel|[0-9]+\\.[0-9]+)$"), staged).otherwise(plain)
    pair = lambda eco, name: F.when(name != "", F.struct(F.lit(eco).alias("ecosystem"), package_id(F.lit(eco), F.regexp_replace(name, "\\.html$", "") if eco == "bioconductor" else name).alias("package")))
    return F.coalesce(pair("bioconductor", bioc), pair("pypi", pypi), pair("cran", cran))


def home_form(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(url)), "^https?://(www\\.)?", ""), "/+$", "")


def identifier(kind: Column, value: Column) -> Column:
    """kind:value with the value's url or prefix taken off; null for an empty value."""
    v = F.lower(F.btrim(F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)))
    v = F.when(kind == "doi", F.regexp_replace(v, "^(?:https?://(?:dx\\.)?doi\\.org/|doi:)", "")).when(kind.isin("pmcid", "openalex", "pmid"), F.regexp_replace(F.regexp_replace(v, "/+$", ""), "^.*/", "")).otherwise(v)
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat_ws(":", kind, v))


def ids_in_text(text: Column) -> Column:
    """PMC ids and DOIs in free text, lower-cased, trailing punctuation off, distinct and sorted."""
    found = F.regexp_extract_all(text, F.lit("(PMC[0-9]{5,}|10\\.[0-9]{4,9}/[^\\s\"<>]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.lower(x), "[.,;)]+$", ""))))


def context_tokens(text: Column) -> Column:
    """[a-z][a-z0-9]+ words without stop words, stemmed."""
    w = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9]+)"), F.lit(1)), lambda x: ~x.isin(*CONTEXT_STOPWORDS))

    def stem(x: Column) -> Column:
        out = None
        for e in STEM_ENDINGS:
            fits, cut = F.endswith(x, F.lit(e)) & (F.length(x) - len(e) >= 4), F.substring(x, F.lit(1), F.length(x) - len(e))
            out = F.when(fits, cut) if out is None else out.when(fits, cut)
        return out.otherwise(x)

    return F.transform(w, stem)


def index_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(exact_form(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda x: F.length(x) >= 2)


def alnum_fold(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def kwic(text: Column, start: Column, end: Column, around: int = 250) -> Column:
    """Context with [[hit]] marked and white space collapsed; start and end are code points, end exclusive."""
    low = F.greatest(start - around, F.lit(0))
    sub = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    return collapse(F.concat(sub(low, start), F.lit("[["), sub(start, end), F.lit("]]"), sub(end, end + around)))


def only_occurrence(text: str, value: str) -> Column:
    """Start of the only occurrence of one column's value in another's text; null if there is none or a second one."""
    return F.expr(f"CASE WHEN {value} <> '' AND locate({value}, {text}) > 0 AND locate({value}, {text}, locate({value}, {text}) + 1) = 0 THEN locate({value}, {text}) - 1 END")


def seed_match(query: Column, found: Column) -> Column:
    """Equal folds, or one inside the other with three characters or more."""
    q, p = alnum_fold(query), alnum_fold(found)
    return (q == p) | ((F.least(F.length(q), F.length(p)) >= 3) & (F.contains(q, p) | F.contains(p, q)))
