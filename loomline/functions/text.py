"""Column functions over message and news text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words of the news pipeline, with the tokens its tokeniser makes of quotes and links.
STOP_WORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot could couldn't "
    "did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's "
    "hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on "
    "once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs "
    "them themselves then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're "
    "we've were weren't what what's when when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your "
    "yours yourself yourselves `` '' link"
).split()
# A few registries under which domains are sold; the table of all of them can be given instead.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.nz", "co.jp", "com.br")


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def simple_tokens(text: Column) -> Column:
    """Lower-cased words split at white space; an empty text has none."""
    clean = F.lower(squeeze(text))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def lower_all(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def normalise(token: Column) -> Column:
    """Lower case, plain quotes, dots for the ellipsis, <num> for digits, in this order."""
    token = F.regexp_replace(F.lower(token), "``|''|‘‘|’’|“|”", '"')
    token = F.regexp_replace(token, "`|‘|’", "'")
    return F.regexp_replace(F.regexp_replace(token, "…", "..."), "[0-9]+", "<num>")


def unigrams(tokens: Column) -> Column:
    """Normalised tokens of two characters or more that aren't stop words or only punctuation."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.transform(tokens, normalise), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t) & ~t.rlike(r"^[^A-Za-z0-9_]+$"))


def bigrams(tokens: Column) -> Column:
    """Neighbouring normalised tokens joined by __, before any filtering."""
    norm = F.transform(tokens, normalise)
    pairs = F.zip_with(F.slice(norm, F.lit(1), F.size(norm) - 1), F.slice(norm, F.lit(2), F.size(norm) - 1), lambda a, b: F.concat(a, F.lit("__"), b))
    return F.when(F.size(norm) > 1, pairs).otherwise(F.array().cast("array<string>"))


def terms(tokens: Column) -> Column:
    return F.concat(unigrams(tokens), bigrams(tokens))


def strip_quotes(token: Column) -> Column:
    return F.regexp_replace(token, '^"+|"+$', "")


def _strip(text: Column) -> Column:
    """Blanks off both ends, then colons, then blanks."""
    space = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    return space(F.regexp_replace(space(text), "^:+|:+$", ""))


# The forms in which messages quote others.
RETWEET = r"\(*RT[\s!.-:]*@\w+(?:[\)\s:]|$)"
LEADING_RT = r"RT[\s!.-:]+"
VIA = r"(?:\(via @\w+\)| via @\w+)"


def quoted(text: Column) -> Column:
    """The part of a message that it quotes from someone else, '' if none.

    A retweet mark with a name: what follows it, or what precedes it if nothing follows. A leading RT with a name
    anywhere: what follows the name. 'via' a name, which overrides: what precedes it, less one closing mark; at the
    very start of the text it needs a bracketed comment, and the part between is meant. Null stays null.
    """
    around = lambda pattern, group: F.regexp_extract(text, rf"(?s)^(.*?){pattern}(.*)$", group)
    after, before = around(RETWEET, 2), around(RETWEET, 1)
    marked = F.when(after == "", _strip(before)).otherwise(_strip(after))
    led = F.regexp_extract(text, r"(?s)^RT[\s!.-:]+.*?@\w+(.*)$", 1)
    rt = F.when(text.rlike(RETWEET), marked).when(text.rlike(rf"^{LEADING_RT}") & text.rlike(r"@\w"), led).otherwise(F.lit(""))
    ahead = F.when(text.rlike(r"\(via @\w+\)"), around(r"\(via @\w+\)", 1)).otherwise(around(r" via @\w+", 1))
    trimmed = F.trim(F.regexp_replace(F.trim(ahead), r"[|,./]$", ""))
    opening = F.regexp_extract(text, r"(?s)^(?:\(via @\w+\)| via @\w+)(.*?)\[.*\]", 1)
    via = F.when(ahead == "", F.trim(F.regexp_replace(F.trim(opening), "^:", ""))).otherwise(trimmed)
    return F.when(text.isNull(), F.lit(None).cast("string")).when(text.rlike(VIA), via).otherwise(rt)


def dedup_key(tokens: Column) -> Column:
    """Short messages: all tokens in lower case. From six tokens on: the first six as written, five if YouTube is among them."""
    n = F.when(F.array_contains(tokens, "YouTube"), 5).otherwise(6)
    return F.when(F.size(tokens) >= 6, F.array_join(F.slice(tokens, F.lit(1), n), " ")).otherwise(F.lower(F.array_join(tokens, " ")))


def source_domain(link: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Registered domain of a link, null if it isn't http(s) or its host is a number address. The target of a
    redirector counts instead of the redirector. ``suffixes`` are the registries of two parts or more under which domains
    are sold, such as the public list of them."""
    at = F.instr(link, "redir.asp?URL=")
    target = F.when(at > 1, F.regexp_extract(link, r"^.*redir\.asp\?URL=(.*)$", 1)).otherwise(link)
    host = F.lower(F.regexp_extract(target, r"^http[^:]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    labels = F.split(host, r"\.")
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    parts = F.lit(2)
    for n in sorted({s.count(".") + 1 for s in suffixes}):  # the longest registry that fits counts
        known = F.array(*[F.lit(s) for s in suffixes if s.count(".") + 1 == n])
        parts = F.when((F.size(labels) > n) & F.array_contains(known, tail(n)), n + 1).otherwise(parts)
    domain = F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, F.size(labels) - parts + 1, parts), ".")).otherwise(F.lit(""))
    return F.when(target.startswith("http") & (host != "") & ~host.rlike(r"^[0-9]+(\.[0-9]+){3}$") & ~F.array_contains(labels, "") & (domain != ""), domain)
