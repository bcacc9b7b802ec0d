"""URL identities as column expressions (regular expressions, so malformed URLs never fail)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Query parameters that only track the reader.
TRACKING = r"utm_[a-z0-9_]*|fbclid|gclid|dclid|gbraid|wbraid|gclsrc|msclkid|yclid|igshid|igsh|mc_cid|mc_eid|_ga|_gl|twclid|ttclid|li_fat_id|ref|ref_src|ref_url|cmp|cmpid|ocid|ncid|smid|smtyp|sr_share|ns_mchannel|ns_source|ns_campaign|at_medium|at_campaign|spm|mkt_tok|oly_enc_id|oly_anon_id|wt_mc|vero_id|vero_conv|s_cid|trk|trkcampaign|_hsenc|_hsmi|hsctatracking"


def site_host(url: Column) -> Column:
    """Lower-case host without port and without a leading www., m. or amp. label; null if there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"^(?:(?:www\d?|m|mobile|amp)\.)+(?=[^.]+\.)", "")
    return F.when(host != "", host)


def page_key(url: Column) -> Column:
    """What two links to the same page share.

    Ignored: scheme, port, www/m/amp host label, letter case of the host, a final slash, the fragment and
    tracking parameters; other parameters count, in any order.  Null for null, blank and host-less links.
    """
    text = F.trim(F.regexp_replace(url, r"^\s+|\s+$", ""))
    bare = F.regexp_replace(text, r"#.*$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?i:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(F.regexp_replace(query, "&amp;", "&"), "&"), lambda p: (p != "") & ~p.rlike(rf"^(?i:{TRACKING})(?:=|$)")))
    return F.when(site_host(text).isNotNull(), F.concat_ws("", site_host(text), path, F.lit("?"), F.array_join(kept, "&")))
