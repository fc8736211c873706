"""HTML extraction: the main text of pages, by a suffix array over the pages of a host.

A page is read as blocks of text, and structure marks them: tags, roles and the words of classes and ids tell menus,
adverts, notices, forms, comments and the like, which are left out; blocks under an <article>, or else a <main>, are
sure text. The words of all blocks left, page after page of a host, make one stream of tokens. Its stretches around each
shared anchor (see windows.py; a run that recurs has its anchor more than once) are put end to end; in their suffix array,
neighbours that agree on RUN words, or on a whole shorter block, are one run, and a run that lies on at least SPREAD of
the host's pages is boilerplate. Sure text stays however often it is repeated: it is the article's. On pages without any,
what boilerplate covers is taken out and the runs left are kept.

A host's pages are dealt by a hash to groups of about GROUP pages or GROUP_BYTES, so that a large host is many groups.
The share is the whole host's, exactly: a run on SPREAD of a host's pages is on SPREAD of some group's, so the suffix
arrays of the groups find every run that can be boilerplate; each group then counts its pages with each run that any
group of the host found, and the sums decide. Runs go between groups as 128 bits of hash.

Defined cases: a null html is an empty page; no text gives the empty string; an element left open ends with the element
around it, a menu or the like that is never closed also where an article begins; an article inside a comment or aside
belongs to that; hidden elements are left out; raw text of scripts and styles ends at their end tag or else with the
page; a `<` that starts no tag is text; on hosts of under three pages nothing is boilerplate; pages that are long or
repeated make groups of about FEWEST different pages; repeated rows come back as often as they came and are one page;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows
from .common import small_batches, written
from .suffixes import suffix_arrays

#: Words of a run; the share of a host's pages (three at least) that makes it boilerplate.
RUN, SPREAD, LEAST = 12, 0.2, 3
#: Pages and bytes of html of a group, and about the different pages that it has at least, as in a group of few pages every
#: run has the share; words looked at together for anchors.
GROUP, GROUP_BYTES, FEWEST, PIECE = 64, 1 << 20, 16, 1 << 20
#: Hosts up to which their table, of under 100 bytes a row, is broadcast.
FEW_HOSTS = 10_000

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^<>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)", re.S)
LOOSE = re.compile(r"[^<>]*(?:>|\Z)")
STOP = re.compile("[<>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Elements by kind, and words of classes, ids and roles that tell what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul title".split()
)
RAW = frozenset("script style noscript template iframe textarea xmp noframes".split())
OUT = frozenset("nav footer aside form menu button select dialog head svg canvas object audio video map label fieldset input".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription share sharing "
    "social comment comments disqus reply replies respond related recommended widget widgets masthead toolbar pagination pager login signup search "
    "form copyright teaser teasers".split()
)
#: Words that a name of such an element may hold besides.
FILLERS = frozenset(
    "area bar block bottom box button buttons card cards center container content footer form group header icons inner item items left line link links list "
    "main message module outer panel post posts primary right row secondary section site slot small stories sub thread top unit user wrap wrapper page "
    "global article articles js c l u b m".split()
)
#: Elements whose text is prose: their ids name places in it, not parts of the page.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th tr dt dd figure figcaption a b i em strong span code".split())
#: Words that make an article element one of many beside the page's own.
OTHER_ARTICLES = frozenset("ad ads advert comment comments reply replies related recommended sponsored promo teaser teasers".split())
HEADER_WORDS = frozenset("header head topbar".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")


def tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the `>` of a tag is whose attributes begin at `at`, quoted values of any length passed over; -1 without one.

    dead: opening quotes from which no end was found; what comes after a quote does not depend on the tag, so that each
    is followed in vain once.
    """
    tried = []
    while m := STOP.search(page, at):
        if m.group() == ">":
            return m.start()
        if m.group() == "<" or m.start() in dead:
            break
        tried.append(m.start())
        at = page.find(m.group(), m.end()) + 1
        if not at:
            break
    dead.update(tried)
    return -1


def names(value: str, wanted: frozenset[str]) -> bool:
    """Whether a name in the value, such as `social-share`, has a word of `wanted` and else only fillers."""
    for name in value.split():
        words = [w for w in SPLIT.split(name) if w and not w.isdigit()]
        if any(w in wanted for w in words) and all(w in wanted or w in OUT_WORDS or w in FILLERS for w in words):
            return True
    return False


def kind_of(tag: str, attributes: str) -> str:
    """"out", "header", "article", "main" or ""."""
    found = {}
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m.group(1).lower(), (m.group(2) or "").strip("\"'").lower())
    if tag in ("html", "body"):
        return ""
    if "hidden" in found and found["hidden"] != "until-found" or HIDDEN.search(found.get("style", "")):
        return "out"
    role, own, ident = found.get("role", ""), found.get("class", ""), found.get("id", "")
    if tag == "article" or found.get("itemprop", "") == "articlebody":
        return "out" if names(own, OTHER_ARTICLES) or role in OUT_ROLES else "article"
    if tag == "main" or role == "main":
        return "main"
    if tag in OUT or role in OUT_ROLES or names(own, OUT_WORDS) or (tag not in PROSE and names(ident, OUT_WORDS)):
        return "out"
    if tag == "header" or (tag in BLOCK and tag not in PROSE and (names(own, HEADER_WORDS) or names(ident, HEADER_WORDS))):
        return "header"
    return ""


def blocks(page: str) -> list[tuple[str, str]]:
    """(place, text) of the blocks of a page; place is "article", "main" or "" and leaves out what is not its text."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements and their kinds
    kinds = dict.fromkeys(("out", "header", "article", "main", ""), 0)
    opened: dict[str, int] = {}

    def place() -> str:
        return "article" if kinds["article"] else "main" if kinds["main"] else ""

    def end_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((place(), text))
            parts.clear()

    def pop() -> None:
        tag, kind = stack.pop()
        opened[tag] -= 1
        kinds[kind] -= 1

    places: dict[str, tuple[list[int], list[int]]] = {}

    def closed_after(tag: str, at: int) -> bool:
        """Whether an element with this tag, open at `at`, has an end tag of its own behind."""
        if tag not in places:
            starts, ends = [], []
            for m in re.finditer(f"<(/?){re.escape(tag)}(?=[\\s>/])", page, re.I):
                (ends if m.group(1) else starts).append(m.start())
            places[tag] = starts, ends
        starts, ends = places[tag]
        return len(ends) - bisect_left(ends, at) > len(starts) - bisect_left(starts, at)

    at = seek = 0
    dead: set[int] = set()
    while True:
        m, end = TOKEN.search(page, seek), -1
        if m and m.group(2):
            end = tag_end(page, m.end(), dead)
            loose = None if end >= 0 else LOOSE.match(page, m.end())
            if end < 0 and not loose:
                seek = m.end()
                continue
        if not kinds["out"]:
            text = page[at : m.start() if m else len(page)]
            if text:
                parts.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        tag = m.group(2)
        if tag is None:
            at = seek = m.end()
            continue
        ends, attributes = bool(m.group(1)), page[m.end() : end] if end >= 0 else ""
        at = seek = end + 1 if end >= 0 else loose.end()
        tag = tag.lower()
        if tag in BLOCK:
            end_block()
        elif tag == "br":
            parts.append(" ")
        if ends:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
            at = seek = end.end() if end else len(page)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        kind = kind_of(tag, attributes)
        if kind in ("article", "main") and kinds["out"]:
            # an article inside belongs to what is left out, unless that was never closed
            outer = [t for t, k in stack if k == "out"]
            if any(closed_after(t, m.start()) for t in outer):
                kind = "out"
            else:
                while kinds["out"]:
                    pop()
        if kind == "header":
            kind = "" if place() else "out"
        if kind == "out":
            end_block()
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            pop()
        stack.append((tag, kind))
        opened[tag] = opened.get(tag, 0) + 1
        kinds[kind] += 1
    end_block()
    return out


def main_text(found: list[tuple[str, str]]) -> str | None:
    """The text of the article's blocks, or else of the main element's; None without either."""
    for wanted in ("article", "main"):
        if any(p == wanted for p, _ in found):
            return "\n\n".join(t for p, t in found if p == wanted)
    return None


def stretches(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, windows, length) of the stretches of blocks around each anchor, and of whole blocks of under a run (no
    windows). Equal runs lie in stretches with equal keys (see windows.py)."""
    value = windows.mix(tokens.astype(np.uint64) * windows.BASE)
    short = ends - starts < run
    key, first, count, length = [], [], [], []
    if short.any():
        a, b = starts[short], ends[short]
        for at in range(0, len(a), PIECE):
            x, y = a[at : at + PIECE], b[at : at + PIECE]
            sums = windows.Sums(value[x[0] : y[-1]])
            key.append(sums.of(x - x[0], y - x[0]))
        first.append(a)
        count.append(np.zeros(len(a), np.int64))
        length.append(b - a)
    # long blocks, very long ones in parts that overlap by a run, some at a time
    parts = [(at, min(b, at + PIECE + run - 1)) for a, b in zip(starts[~short].tolist(), ends[~short].tolist()) for at in range(a, b - run + 1, PIECE)]
    while parts:
        some, size = [], 0
        while parts and size < PIECE:
            some.append(parts.pop())
            size += some[-1][1] - some[-1][0]
        places = np.concatenate([np.arange(a, b) for a, b in some])
        bounds = np.concatenate([[0], np.cumsum([b - a for a, b in some])])
        _, f, n, h, _, _ = windows.segments(value[places], bounds, run, max(1, run // 2))
        key.append(h)
        first.append(places[f])
        count.append(n)
        length.append(n + run - 1)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else y for x, y in ((key, none.astype(np.uint64)), (first, none), (count, none), (length, none)))


def repeated_runs(tokens: np.ndarray, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of the runs that lie on at least `least` owners; a run is `run` tokens of a block or a whole shorter one.

    Stretches that share an anchor are put end to end, and what agrees is together in the suffix array of each such string.
    """
    key, first, count, length = stretches(tokens, starts, ends, run)
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[inverse] > 1)
    some = some[np.argsort(inverse[some], kind="stable")]
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, count, length, label = first[some], count[some], length[some], inverse[some]
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    own = np.repeat(np.arange(len(some)), length + 1)
    j = np.arange(begin[-1]) - begin[own]
    place = first[own] + j
    letters = np.where(j < length[own], tokens[np.minimum(place, len(tokens) - 1)], 0)
    heads = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    order = suffix_arrays(letters, np.append(begin[heads], begin[-1]))
    order = order[j[order] < np.maximum(count[own[order]], 1)]
    reach = np.where(count[own] > 0, run, length[own] + 1)
    padded = np.append(letters, np.zeros(run, letters.dtype))
    a, b = order[:-1], order[1:]
    alike = (label[own[a]] == label[own[b]]) & (reach[a] == reach[b])
    for k in range(run):
        at = np.flatnonzero(alike)
        alike[at] = (padded[a[at] + k] == padded[b[at] + k]) | (reach[a[at]] <= k)
    number = np.concatenate([[0], np.cumsum(~alike)])
    pages = np.unique(np.stack([number, owner[place[order]]], 1), axis=0)
    hit = order[(np.bincount(pages[:, 0], minlength=number[-1] + 1) >= least)[number]]
    return place[hit], np.where(count[own[hit]] > 0, run, length[own[hit]])


class Words(NamedTuple):
    """The words of pages: numbers, two hashes a word, the page of each, and where blocks start and end."""

    tokens: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words_of(pages: list[list[str]]) -> Words:
    """pages: the blocks of each page."""
    numbers: dict[str, int] = {}
    tokens, owner = [np.zeros(0, np.int64)], []
    for i, page in enumerate(pages):
        for block in page:
            tokens.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in block.split()], np.int64))
            owner.append(i)
    sizes = np.array([len(t) for t in tokens[1:]], np.int64)
    ends = np.cumsum(sizes)
    hashes = np.frombuffer(b"".join(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in numbers), np.uint64)
    return Words(np.concatenate(tokens), hashes.reshape(-1, 2), np.repeat(np.array(owner, np.int64), sizes), ends - sizes, ends)


def all_runs(words: Words, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of every run: `run` words of a block or a whole shorter one."""
    size = words.ends - words.starts
    count = np.where(size < run, np.minimum(size, 1), size - run + 1)
    at = np.repeat(words.starts - np.cumsum(count) + count, count) + np.arange(count.sum())
    return at, np.repeat(np.minimum(size, run), count)


def run_keys(words: Words, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two hashes of each run, as rows of longs."""
    sums = (windows.Sums(words.hashes[words.tokens - 1, k]) for k in (0, 1))
    return np.stack([s.of(at, at + n) for s in sums], 1).view(np.int64)


def frequent(words: Words, least: int, run: int) -> np.ndarray:
    """Keys, each once, of the runs that lie on at least `least` of the pages."""
    if least < 2:
        at, n = all_runs(words, run)
    else:
        at, n = repeated_runs(words.tokens, words.owner, words.starts, words.ends, least, run)
    return np.unique(run_keys(words, at, n), axis=0) if len(at) else np.zeros((0, 2), np.int64)


def found_again(words: Words, keys: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the key, place, length) of the runs that have one of the keys."""
    at, n = all_runs(words, run)
    mine = run_keys(words, at, n)
    some = np.flatnonzero(np.isin(mine[:, 0], keys[:, 0]))
    number = {k: i for i, k in enumerate(map(tuple, keys.tolist()))}
    which = np.array([number.get(k, -1) for k in map(tuple, mine[some].tolist())], np.int64)
    return which[which >= 0], at[some[which >= 0]], n[some[which >= 0]]


def pages_with(words: Words, keys: np.ndarray, run: int) -> np.ndarray:
    """On how many of the pages each key's run lies."""
    which, at, _ = found_again(words, keys, run)
    pairs = np.unique(np.stack([which, words.owner[at]], 1), axis=0)
    return np.bincount(pairs[:, 0], minlength=len(keys))


def without(pages: list[list[str]], keys: np.ndarray, run: int) -> list[str]:
    """Each page's text without the words that the keys' runs cover."""
    words = words_of(pages)
    gone = np.zeros(len(words.tokens) + 1, np.int64)
    if len(keys):
        _, at, n = found_again(words, keys, run)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + n, -1)
    covered = np.cumsum(gone) > 0
    cuts = zip(words.starts.tolist(), words.ends.tolist())
    out = []
    for page in pages:
        kept = (" ".join(w for w, m in zip(block.split(), covered[a:b]) if not m) for block, (a, b) in zip(page, cuts))
        out.append("\n\n".join(k for k in kept if k))
    return out


def share(pages: int, spread: float = SPREAD) -> int:
    """The pages that are `spread` of so many, rounded up."""
    return -(-int(spread * 100) * pages // 100)


def unique_runs(pages: list[list[str]], run: int = RUN, spread: float = SPREAD) -> list[str]:
    """Each page's text without the word runs that recur on many of the pages. pages: the blocks of each page of a host."""
    return without(pages, frequent(words_of(pages), max(LEAST, share(len(pages), spread)), run), run)


def texts(pages: list[list[tuple[str, str]]], keys: np.ndarray) -> list[str]:
    """The main text of pages, from their (place, text) blocks; keys: those of the host's boilerplate."""
    sure = [main_text(page) for page in pages]
    plain = iter(without([[t for _, t in page] for page, text in zip(pages, sure) if text is None], keys, RUN))
    return [next(plain) if text is None else text for text in sure]


def host_texts(pages: list[list[tuple[str, str]]]) -> list[str]:
    """The main text of each of a host's pages, from their (place, text) blocks."""
    return texts(pages, frequent(words_of([[t for _, t in page] for page in pages]), max(LEAST, share(len(pages))), RUN))


PLACES = {"a": "article", "m": "main", " ": ""}


def packed(page: str) -> str:
    """The blocks of a page, a line each behind a letter for the place; texts of blocks hold no line ends."""
    return "\n".join((p[:1] or " ") + t for p, t in blocks(page))


def unpacked(page: str) -> list[tuple[str, str]]:
    return [(PLACES[line[0]], line[1:]) for line in page.split("\n")] if page else []


def different(frame: pd.DataFrame) -> list[str]:
    """The packed blocks of a group's pages; repeated rows are one page, else they would make each other's text boilerplate."""
    return frame[["page_id", "url", "blocks"]].drop_duplicates()["blocks"].tolist()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    # ids go through pandas as text: longs beside a null would become doubles
    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    many = F.ceil(F.greatest(F.count("*") / GROUP, F.sum(F.octet_length("html")) / GROUP_BYTES))
    enough = F.floor(F.approx_count_distinct(F.xxhash64("page_id", "url", "html")) / FEWEST)
    sizes = written(rows.groupBy("host").agg(F.greatest(F.lit(1), F.least(many, enough)).cast("long").alias("groups")))
    few = F.broadcast(sizes) if sizes.count() <= FEW_HOSTS else sizes

    def read(frames):
        for f in frames:
            yield f[["page_id", "url", "host"]].assign(blocks=pd.Series([packed(page) for page in f["html"]], f.index, object))

    def in_group(frame: pd.DataFrame) -> pd.DataFrame:
        found = different(frame)
        groups = int(frame["groups"].iloc[0])
        # the only group of a host decides; of several, one has its share of whatever has the host's
        least = share(len(found)) if groups > 1 else max(LEAST, share(len(found)))
        keys = frequent(words_of([[t for _, t in unpacked(page)] for page in found]), least, RUN)
        return pd.DataFrame({"host": frame["host"].iloc[0], "groups": groups, "a": keys[:, 0], "b": keys[:, 1]})

    def counted(frame: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        keys = runs[["a", "b"]].to_numpy(np.int64)
        some, pages, of = keys[:0], np.zeros(0, np.int64), 0
        if not frame.empty:
            found = different(frame)
            of = len(found)
            if len(keys):
                pages = pages_with(words_of([[t for _, t in unpacked(page)] for page in found]), keys, RUN)
                some, pages = keys[pages > 0], pages[pages > 0]
        # the first row holds the group's number of pages
        one = (runs if frame.empty else frame).iloc[0]
        a, b = np.concatenate([[[0, 0]], some]).T
        return pd.DataFrame({"host": one["host"], "groups": int(one["groups"]), "a": a, "b": b, "pages": np.append(0, pages), "of": np.append(of, np.zeros_like(pages))})

    def main(frame: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        found = texts([unpacked(page) for page in frame["blocks"]], runs[["a", "b"]].to_numpy(np.int64))
        return frame[["page_id", "url"]].assign(text=pd.Series(found, frame.index, object))  # a group may have no pages

    def by_group(runs: DataFrame):
        """Each group's pages beside the runs of its host."""
        every = runs.select("host", "groups", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
        return dealt.groupBy("host", "group").cogroup(every.groupBy("host", "group"))

    dealt = rows.mapInPandas(read, "page_id string, url string, host string, blocks string").join(few, "host")
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("page_id", "url", "blocks"), F.col("groups")))
    # dealt by host and group, as a host alone would be one task; read three times from one shuffle
    dealt = dealt.repartition("host", "group")
    run = "host string, groups long, a long, b long"
    runs = dealt.groupBy("host", "group").applyInPandas(in_group, run).distinct()
    runs = by_group(runs).applyInPandas(counted, f"{run}, pages long, of long").groupBy("host", "groups", "a", "b").agg(F.sum("pages").alias("pages"), F.sum("of").alias("of"))
    runs = runs.withColumn("of", F.sum("of").over(Window.partitionBy("host")))
    runs = runs.where((F.col("pages") >= LEAST) & (F.col("pages") * 100 >= F.col("of") * int(SPREAD * 100)))
    out = by_group(runs).applyInPandas(main, "page_id string, url string, text string")
    return out.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9(pages: DataFrame) -> DataFrame:
    return extract(pages)
