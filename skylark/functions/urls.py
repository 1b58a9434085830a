"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

# Public suffixes of two labels that the domain rule knows; others count as one label.
TWO_LABEL_SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk com.au net.au org.au edu.au gov.au co.nz org.nz net.nz "
    "co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr com.br net.br org.br gov.br com.mx org.mx gob.mx com.ar org.ar gob.ar "
    "com.co com.pe com.ve com.uy com.ec com.es org.es nom.es gob.es edu.es com.pt com.tr com.cn net.cn org.cn gov.cn "
    "com.hk com.sg com.tw com.my co.in net.in org.in gov.in co.id co.th co.za org.za co.il org.il com.pl com.ua com.ru"
).split()


def with_scheme(url: Column | str) -> Column:
    """The URL with http:// in front unless it has a scheme or begins with //."""
    url = F.trim(col(url))
    return F.when(url.rlike("^(https?:)?//"), url).otherwise(F.concat(F.lit("http://"), url))


def host(url: Column | str) -> Column:
    """The lower-case host without user and port; works without a scheme."""
    authority = F.regexp_extract(F.trim(col(url)), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$|\.$", ""))


_PROXY = r"^(?:(?:https?:)?//)?translate\.google\.com(?::\d+)?/translate[^?#]*\?(?:[^#]*&)?u="


def registrable_domain(host_: Column) -> Column:
    """The last two labels, three under a two-label suffix; null for addresses, single labels and hosts with empty labels."""

    def of(h: Column) -> Column:
        two, three = F.substring_index(h, ".", -2), F.substring_index(h, ".", -3)
        named = (F.instr(h, ".") > 0) & ~h.rlike(r"^[0-9.]+$|[:\[\]]|\.\.|^\.|\.$")
        suffix = two.isin(TWO_LABEL_SUFFIXES)
        return F.when(named & ~suffix, two).when(named & (three != two), three)

    return F.get(F.transform(F.array(host_), of), F.lit(0))


def suffix_domains(df: DataFrame, host_: str, rules: DataFrame, out: str = "domain") -> DataFrame:
    """df with the registrable domain of a host by a table of public-suffix rules of any size.

    rules (rule) are names such as `uk`, `co.uk`, wildcards `*.ck` and exceptions `!www.ck`, as in the public list. Each
    distinct host is opened to its suffixes, which are joined with the rules; an exception wins, else the
    longest rule, else the last label counts as the suffix. The domain is the suffix and one label more, null where
    the host has none, is null or an address. Hosts of any number of labels: a rule has at most as many as the
    longest rule (one number that comes to the driver), so no more suffixes are made.
    """
    rule = F.lower(F.trim("rule"))
    table = rules.filter(F.length(F.trim("rule")) > 0).select(
        F.regexp_replace(rule, r"^(?:!|\*\.)", "").alias("_suffix"),
        F.when(F.startswith(rule, F.lit("!")), 0).when(F.startswith(rule, F.lit("*.")), 2).otherwise(1).alias("_more"),
    )
    most = (table.agg(F.max(F.size(F.split("_suffix", r"\.")))).first()[0] or 1) + 1
    named = df.select(F.lower(host_).alias("_host")).filter(~F.col("_host").rlike(r"^[0-9.]+$|[:\[\]]|\.\.|^\.|\.$") & (F.instr("_host", ".") > 0)).distinct()
    labels = F.size(F.split("_host", r"\."))
    opened = named.withColumn("_labels", labels).select("_host", "_labels", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), "_labels"))).alias("_n"))
    opened = opened.withColumn("_suffix", F.call_function("substring_index", "_host", F.lit("."), -F.col("_n")))
    met = opened.join(table.distinct(), "_suffix")
    # Labels of the public suffix: an exception's own name less one, a wildcard's and one more, a plain rule's.
    size = F.col("_n") + F.col("_more") - 1
    best = met.filter(size <= F.col("_labels")).groupBy("_host").agg(F.max(F.struct((F.col("_more") == 0).alias("exception"), size.alias("size"))).alias("b"))
    found = named.join(best, "_host", "left").withColumn("_size", F.coalesce("b.size", F.lit(1)) + 1)
    domain = F.when(F.size(F.split("_host", r"\.")) >= F.col("_size"), F.call_function("substring_index", "_host", F.lit("."), -F.col("_size")))
    return df.withColumn("_host", F.lower(host_)).join(found.select("_host", domain.alias("_domain")), "_host", "left").withColumn(out, F.col("_domain")).drop("_host", "_domain")


def _target(url: Column) -> Column:
    """What a translation proxy's URL points to; other URLs stay."""
    wrapped = F.try_url_decode(F.regexp_extract(url, r"[?&]u=([^&#]*)", 1))
    return F.when(url.rlike(_PROXY), F.coalesce(wrapped, url)).otherwise(url)


def extract_domain(url: Column | str, with_subdomain: bool = False, resolve_translate: bool = True) -> Column:
    """The registrable domain (or the host without www.) of a URL; the input where there is none."""
    url = col(url)
    target = _target(F.trim(url)) if resolve_translate else F.trim(url)
    if with_subdomain:
        return F.when(url == "", url).otherwise(F.regexp_replace(host(target), r"^www\.", ""))
    return F.coalesce(registrable_domain(host(target)), url)


def normalize_url(url: Column | str, remove_params: bool = True) -> Column:
    """Without fragment (and query), host in lower case, no default port, / as the least path; others unchanged."""
    url = col(url)
    trimmed = F.trim(url)
    part = lambda i: F.regexp_extract(trimmed, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", i)
    scheme, authority = F.lower(part(1)), F.lower(part(2))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).otherwise(F.when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority))
    path = F.when(part(3) == "", "/").otherwise(part(3))
    query = F.lit("") if remove_params else F.when(part(4) == "?", "").otherwise(part(4))
    return F.when((part(1) != "") & (part(2) != ""), F.concat(scheme, F.lit("://"), authority, path, query)).otherwise(url)


def is_domain(value: Column | str) -> Column:
    """A bare host name, without scheme, path or spaces."""
    value = col(value)
    return value.rlike(r"^(?!-)[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}$") & ~F.contains(value, F.lit(".."))
