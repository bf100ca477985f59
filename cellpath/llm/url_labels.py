"""A small table of labelled urls, made by rule from short word lists: what a filter for training data blocks, and ordinary sites.

Prefixes, endings, domains and paths are dealt out alike to both labels, so that only the words tell them apart. Most urls
are ordinary ones of names without a known word.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession

# Words of hosts and paths that are blocked (gambling, adult, drug trade, adverts and trackers, spam, piracy, dubious offers).
BLOCKED = """casino poker slots jackpot roulette betting bets lottery gamble adult porn xxx sex nude escort webcam pills viagra
cialis pharmacy steroids drugs spam malware phishing scam warez crack keygen torrent ads adserver banner popup track
tracker clicks affiliate linkfarm clickbait loans payday forex replica cheap free win prize giveaway miracle""".split()

# Words of ordinary sites.
ORDINARY = """news weather library museum school university recipes garden travel health science music books sports city
forum wiki photo history astronomy archive gallery kitchen theatre village river mountain engineer teacher journal
magazine review guide market council hospital church cinema farming railway harbour language grammar poetry physics biology""".split()

# Frequent pairs of letters and endings, of which ordinary names without a known word are made.
PAIRS = "th he in er an re on at en nd st es ng ed or ti hi as to ar te se ha ou it le is al ing tion ment able ness".split()

_SITES = [".example", ".site", ".page", ""]
_DOMAINS = ["com", "net", "org", "info", "de", "fr"]
_FRONTS = ["www.", "", "m.", "blog."]
_PATHS = ["/", "/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}", "/index.html", "/a/{n}", ""]
#: A site named by the word, alone or with another part, and a neutral site with the word in its path.
_FORMS = ["{a}{s}.{d}{p}", "{a}-{b}{s}.{d}{p}", "{b}-{a}{s}.{d}{p}", "{a}{b}{s}.{d}{p}", "{b}{a}{s}.{d}{p}", "{b}{s}.{d}/{a}/{n}"]


def _names() -> list[str]:
    """Names of two to four pairs of letters."""
    n = len(PAIRS)
    return ["".join(PAIRS[(i * (3 + 4 * k) + k * k) % n] for k in range(2 + i % 3)) for i in range(14 * n)]


def labelled_rows() -> list[tuple[str, bool]]:
    """All labelled urls: ``(url, blocked)``, in pairs that differ in one word only, and sites of neutral names."""
    names, found = _names(), []
    ordinary = [w for pair in zip(ORDINARY * 8, names) for w in pair]
    for i, (form, word) in enumerate(product(_FORMS, BLOCKED)):
        for other in (names[(17 * i) % len(names)], BLOCKED[(5 * i + 1) % len(BLOCKED)]):
            for a, blocked in ((word, True), (ordinary[(len(found) // 2) % len(ordinary)], False)):
                b = other if blocked or other in names else ORDINARY[i % len(ORDINARY)]
                path = _PATHS[i % 8].format(n=101 + 37 * i)
                rest = form.format(a=a, b=b, s=_SITES[(i // 6) % 4], d=_DOMAINS[i % 6], p=path, n=211 + 13 * i)
                found.append((f"http{'s' * (i % 2)}://{_FRONTS[(i // 2) % 4]}{rest}", blocked))
    for i, (a, front) in enumerate(product(names + ORDINARY, _FRONTS)):
        path = _PATHS[(i + i // 8) % 8].format(n=101 + 7 * i)
        found.append((f"http{'s' * (i // 4 % 2)}://{front}{a}{_SITES[(i // 5) % 4]}.{_DOMAINS[i % 6]}{path}", False))
    return found


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "url string, blocked boolean").coalesce(1)
