"""Main text of web pages by differencing each page against the nearest URLs of its host.

A page is cut into lines: a block's text and the slot that it fills, the path of its open elements with their classes. Pages are
sorted by host and URL path; a page's mates are the pages before and after it, so that each pair shares the longest path around.
A pair's lines are aligned by longest common subsequence, and what both have is page furniture and deleted. Lines of an article or
main element count as shared only by slot *and* text, and are kept if they are (a repeated passage is no furniture);
lines elsewhere are compared by slot alone where their elements are marked as furniture (menus and adverts change their
words from page to page), else by slot and text. A mate that shares most of a page's text is a copy and proves nothing.
What no mate can show (a host's only page) falls to the marks: furniture goes, and a page with an article or main element is that.

Only lines' hashes are sorted and paired, in a range-partitioned order of all pages, so that a host may hold any share of
them; the pages themselves are joined once with the few numbers of the lines to delete.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import map_batches, stored

#: A mate that shares so large a part of a page's comparable text is a copy.
COPY_SHARE = 0.6

#: HTML elements without an end, inline elements, elements whose content is no text, and furniture by name.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas head title textarea select".split())
FURNITURE = frozenset("nav footer aside form header dialog menu button".split())
LANDMARKS = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class names and ids that mark furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Those that mark a heading inside an article.
TITLES = frozenset("banner header masthead".split())
#: Elements that an opening block closes, so that unclosed paragraphs and items don't nest.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
BLOCK_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|textarea|title|noscript|template|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_WORD = re.compile(r"[a-z]+")

Line = tuple[str, str, bool, bool]


def marked(name: str, rest: str, main: bool) -> tuple[int, str]:
    """How surely an element is furniture, and its class as part of a slot: 2 by its name, role or a whole class name or id,
    1 by a word in one, 0 not at all. In an article or main element a header belongs to the text."""
    found = 2 * (name in FURNITURE and not (main and name == "header"))
    kind = ""
    for m in _ATTRIBUTE.finditer(rest) if rest else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            marks = MARKS - TITLES if main else MARKS
            found = max(found, 2 * (not marks.isdisjoint(value.split())), int(not marks.isdisjoint(_NAME_WORD.findall(value))))
            kind = value if key == "class" else kind
        elif key == "role":
            found = max(found, 2 * (value in ROLES))
        elif key == "hidden" or value == "true":
            found = 2
    return found, kind


def lines_of(page: str | None) -> list[Line]:
    """(slot, text, is in an article or main element, is in furniture) of every block with text, in page order."""
    if not page:
        return []
    out: list[Line] = []
    stack: list[tuple[str, bool, int, str]] = []  # name, landmark, furniture, slot: each with what is above it
    text: list[str] = []
    silent = 0

    def flush() -> None:
        words = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if words:
            _, main, away, slot = stack[-1] if stack else ("", False, 0, "")
            out.append((slot, words, main, away > 0))

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at and not silent:
            text.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name in INLINE and name not in SILENT:
            continue
        if name in VOID:
            if name in ("br", "hr") and not silent:
                flush()
            continue
        if m["end"]:
            if any(x[0] == name for x in stack):
                if not silent:
                    flush()
                while stack:
                    gone = stack.pop()[0]
                    silent -= gone in SILENT
                    if gone == name:
                        break
            continue
        if not silent:
            flush()
        closes = CLOSES.get(name) or ({"p"} if name in BLOCK_CLOSES_P else ())
        while stack and stack[-1][0] in closes:
            silent -= stack.pop()[0] in SILENT
        if m["rest"].rstrip().endswith("/"):
            continue
        _, main, away, slot = stack[-1] if stack else ("", False, 0, "")
        own, kind = marked(name, m["rest"], main)
        landmark = name in LANDMARKS or 'role="main"' in m["rest"]
        if landmark and away < 2:
            away = 0  # a class such as with-sidebar around the article
        if name not in ("html", "body"):
            away = max(away, own)
        stack.append((name, main or landmark, away, f"{slot}/{name}.{kind}"))
        silent += name in SILENT
    if not silent:
        text.append(page[at:])
        flush()
    return out


def keys_of(lines: list[Line]) -> list[tuple[int, int, int]]:
    """Runs of lines as they are compared: (hash, number of lines, characters that count as the page's own text)."""
    out: list[list] = []
    for slot, text, main, away in lines:
        loose = away and not main
        key = xxhash.xxh64_intdigest(slot if loose else f"{slot}\0{text}") - (1 << 63)
        if loose and out and out[-1][0] == key:
            out[-1][1] += 1
        else:
            out.append([key, 1, 0 if loose else len(text)])
    return [tuple(x) for x in out]


def shared_runs(a: list[int], b: list[int]) -> list[int]:
    """Numbers of a's runs in a longest common subsequence of a and b (Hunt and Szymanski: work follows the equal pairs)."""
    places: dict[int, list[int]] = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        places[b[j]].append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i, key in enumerate(a):
        for j in places.get(key, ()):
            k = bisect_left(ends, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            else:
                ends[k], chains[k] = j, chain
    out, chain = [], chains[-1] if chains else None
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def main_text(page: str | None, shared: list[int] | None) -> str:
    """The page's text without its furniture and without the shared runs."""
    lines = lines_of(page)
    gone = set(shared or ())
    kept, k = [], 0
    for number, (_, n, _) in enumerate(keys_of(lines)):
        for line in lines[k : k + n]:
            if line[2] and not line[3] or number not in gone:
                kept.append(line)
        k += n
    whole = any(main and not away for _, _, main, away in kept)
    return " ".join(text for _, text, main, away in kept if not away and (main or not whole))


def sketch(pages: DataFrame, html_col: str, url_col: str) -> DataFrame:
    """(k1, k2, host, path, runs, sizes): one row for each different page of a URL."""

    def make():
        def work(urls, docs):
            hosts, paths, runs, sizes = [], [], [], []
            for url, page in zip(urls.to_pylist(), docs.to_pylist(), strict=True):
                host, _, path = re.sub(r"^[a-zA-Z][\w+.\-]*://", "", url or "").partition("/")
                keys = keys_of(lines_of(page))
                hosts.append(host.lower())
                paths.append(re.split(r"[?#]", path)[0])
                runs.append([k for k, _, _ in keys])
                sizes.append([n for _, _, n in keys])
            return [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(runs, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]

        return work

    fields = [T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("runs", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType()))]
    return map_batches(pages, [url_col, html_col], fields, make, ["k1", "k2"])


def mates(sketches: DataFrame) -> DataFrame:
    """Each page beside the next of its host in URL order: their sketches as (a, b)."""
    order = ["host", "path", "k1", "k2"]
    ranked = stored(sketches.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "pages-ranked")
    ends = ranked.groupBy(F.shiftright("at", 33).alias("part")).agg(F.max("at").alias("at"), F.min("at").alias("first"))  # a row a partition
    after = ends.select("at", F.lead("first").over(Window.orderBy("part")).alias("other"))
    cols = ["host", "path", "k1", "k2", "runs", "sizes"]
    a = ranked.join(F.broadcast(after), "at", "left").select(F.struct(*cols).alias("a"), F.coalesce("other", F.col("at") + 1).alias("at"))
    b = ranked.select("at", F.struct(*cols).alias("b"))
    return a.join(b, "at").where(F.col("a.host") == F.col("b.host")).select("a", "b")


def differences(pairs: DataFrame) -> DataFrame:
    """(k1, k2, shared): the runs that a page shares with its nearer mate that is no copy."""
    fields = "k1 bigint, k2 bigint, near int, shared array<int>"

    def run(batches):
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                near = sum(x == y for x, y in zip(a["path"].split("/"), b["path"].split("/"), strict=False))
                for own, other in ((a, b), (b, a)):
                    same = shared_runs(own["runs"], other["runs"])
                    if sum(own["sizes"][i] for i in same) <= COPY_SHARE * sum(own["sizes"]):
                        rows.append((own["k1"], own["k2"], near, same))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int32()))], names=["k1", "k2", "near", "shared"])

    found = pairs.mapInArrow(run, fields)
    return found.groupBy("k1", "k2").agg(F.max(F.struct("near", "shared")).alias("best")).select("k1", "k2", F.col("best.shared").alias("shared"))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Adds text, the main text of every page, to every row.

    A null, empty or wordless page has the empty text. A null URL is the URL of no host's root. Rows that repeat a page and its URL
    get one answer; an empty table gives none; a column named text is replaced. Nothing is dropped or cut but furniture.
    """
    keyed = pages.withColumns({"k1": F.xxhash64(url_col, html_col), "k2": F.xxhash64(html_col, F.lit(1), url_col)})
    found = stored(differences(mates(sketch(keyed.select("k1", "k2", url_col, html_col), html_col, url_col).dropDuplicates(["k1", "k2"]))), "pages-shared")
    joined = keyed.join(found.hint("merge"), ["k1", "k2"], "left")  # a row a page: never broadcast, at any size

    def make():
        return lambda docs, shared: [pa.array([main_text(p, s) for p, s in zip(docs.to_pylist(), shared.to_pylist(), strict=True)], pa.string())]

    return map_batches(joined, [html_col, "shared"], [T.StructField("text", T.StringType())], make, [c for c in pages.columns if c != "text"])
