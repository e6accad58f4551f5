"""URL columns as built-in expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of a path that is no page.
ASSET_SUFFIXES = "jpg jpeg png gif webp svg ico bmp avif css js mjs map woff woff2 ttf otf eot zip gz tar rar 7z dmg exe pkg mp4 mp3 webm mov avi wav ogg xml rss atom json txt csv doc docx xls xlsx ppt pptx".split()
# Words of a path that leads to an account.
ACCOUNT_TOKENS = "login signin sign-in logout signout register signup sign-up account cart basket checkout password auth oauth admin wp-admin wp-login".split()
# Query parameters that only track.
TRACKING_PARAMS = "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid mc_cid mc_eid ref ref_src igshid".split()


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def registrable_host(name: Column) -> Column:
    """Lower case, without trailing dots and one leading ``www.``."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\.+$", ""), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    """Equal registrable hosts, or one below the other."""
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def looks_like_page(url: Column) -> Column:
    return ~F.lower(path(url)).rlike(rf"\.({'|'.join(ASSET_SUFFIXES)})$")


def path_depth(url: Column) -> Column:
    inner = F.regexp_replace(path(url), "^/+|/+$", "")
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "/"))).cast("int")


def path_tokens(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), r"[/\-_.]+"), lambda x: x != "")


def is_account_path(url: Column) -> Column:
    return F.arrays_overlap(path_tokens(url), F.array(*map(F.lit, ACCOUNT_TOKENS)))


def path_shape(url: Column, depth: int = 2) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.lower(path(url)), "/"), lambda x: x != ""), 1, depth), "/")


#: Addresses that expressions can spell in the normal form: plain host, small port, no reference that would be written anew.
PLAIN = r"^[A-Za-z]+://[A-Za-z0-9_.-]+(:[1-9][0-9]{0,3})?(/[A-Za-z0-9._~/!$&'()*+,:@%=-]*)?(\?([A-Za-z0-9_.~-]+=[A-Za-z0-9_.~-]*(&+|$|#))*)?(#.*)?$"


def plain_form(url: Column) -> Column:
    """The normal form of an address that ``PLAIN`` matches."""
    s = F.trim(url)
    scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z]+)://", 1))
    port = F.regexp_extract(s, r"^[A-Za-z]+://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    p = F.regexp_replace(path(s), "/{2,}", "/")
    p = F.when((p == "") | (p == "/"), "/").otherwise(F.regexp_replace(p, "/+$", ""))
    query = F.regexp_extract(s, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(F.split(x, "=")[0]).isin(TRACKING_PARAMS))
    asked = F.array_join(kept, "&")
    return F.when(scheme.isin("http", "https") & (host(s) != ""), F.concat(scheme, F.lit("://"), host(s), F.when(default, "").otherwise(F.concat(F.lit(":"), port)), p, F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked))))


def normalize_absolute(url: Column) -> Column:
    """An absolute http(s) URL in one spelling: lower host, no user, default port, doubled or final slash, tracking parameter or fragment. Null for anything else.

    Plain addresses stay in expressions; the others (users, IPv6 hosts, queries to be written anew) go to an Arrow worker, which sees nulls for the plain ones."""
    import pandas as pd

    from pagelens.functions import resolve

    @F.pandas_udf("string")
    def spelt(addresses: pd.Series) -> pd.Series:
        return addresses.map(resolve.normal, na_action="ignore").astype(object)

    is_plain = F.coalesce(F.trim(url).rlike(PLAIN), F.lit(False))
    return F.when(is_plain, plain_form(url)).otherwise(spelt(F.when(~is_plain, url)))
