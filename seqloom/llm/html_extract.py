"""Main text of web pages by site style trees."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune

#: Blocks whose prior times the importance of their branch is below this are removed.
IMPORTANCE = 0.4
#: Importance of a branch that one page alone has, and the pages that this counts for where more have it.
UNSEEN, UNSEEN_PAGES = 0.7, 4
#: Priors by what markup says: neutral text beside a main content, noise, noise on a page without other text; factor of
#: a name of which a part alone says noise. Main content, and neutral text on a page without, have 1.
BESIDE, NAMED, ALONE, DOUBT = 0.45, 0.3, 0.5, 0.6
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that interrupt a line of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements that end an open element of the listed kinds, up to the listed limits.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
ENDS_P = BLOCK - {"body", "html", "head", "title", "option", "optgroup", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend"}
#: Elements that no page shows as its text.
UNSEEN_TAGS = frozenset("head button select script style textarea title iframe noscript noembed noframes template svg object".split())
#: Markup that suggests noise or main content: the prior of a branch.
NOISE_TAGS = frozenset("nav header footer aside form menu dialog".split())
NOISE_NAMES = frozenset("ad ads adv advert advertisement banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar side header masthead footer foot cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login share sharing social comment comments respond disqus related recommended widget pagination pager toolbar skip copyright".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
MAIN_TAGS = frozenset(("article", "main"))
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[a-z]+")
HIDDEN, NOISE, INNER, NEUTRAL, MAIN = range(5)


def _says_noise(names: str) -> tuple[bool, bool]:
    """(whether a name is made of words for noise only, whether a part of one is such a word)."""
    part = False
    for name in names.split():
        noise = [w in NOISE_NAMES for w in _WORDS.findall(name)]
        if noise and all(noise):
            return True, True
        part = part or any(noise)
    return False, part


def _role(tag: str, attributes: str) -> tuple[int, bool, str]:
    """(role that the markup suggests, whether a part of a name makes it doubtful, presentation: the tag with its classes)."""
    role = HIDDEN if tag in UNSEEN_TAGS else NOISE if tag in NOISE_TAGS else MAIN if tag in MAIN_TAGS else NEUTRAL
    if not attributes:
        return role, False, tag
    of: dict = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        of.setdefault(name.lower(), (a or b or c).lower())
    classes, stated, doubt = of.get("class", ""), of.get("role", ""), False
    if "hidden" in of:
        role = HIDDEN
    elif role != HIDDEN:
        if stated in NOISE_ROLES:
            role = NOISE
        elif stated in ("main", "article"):
            role = MAIN
        if role == NEUTRAL and tag not in ("body", "html"):
            noise, doubt = _says_noise(f"{classes} {of.get('id', '')}")
            role = NOISE if noise else role
    return role, doubt, f"{tag}.{'.'.join(sorted(classes.split()))}" if classes else tag


def _under(above: int, role: int) -> int:
    """Role of an element of this role in one of the role above."""
    if HIDDEN in (above, role):
        return HIDDEN
    if role == NOISE:
        return NOISE
    if above == NOISE:
        return INNER if role == MAIN else NOISE
    return above if above in (INNER, MAIN) else role


class _Node:
    __slots__ = ("tag", "role", "doubt", "path", "children")

    def __init__(self, tag, role, doubt, path):
        self.tag, self.role, self.doubt, self.path, self.children = tag, role, doubt, path, []


def blocks(source: str) -> tuple[list[tuple[int, bool, int, str]], list[tuple[int, int]]]:
    """(blocks, presentations) of a page.

    A block is (role, doubt, path, text): the role is MAIN, NOISE or NEUTRAL by the elements around it, or INNER for main
    content inside noise; path hashes the presentations from the body down. A presentation is (path, hash of the
    children's presentations), for each element with children."""
    root = _Node("#", NEUTRAL, False, 0)
    stack = [root]
    found, styles, text = [], [], []

    def flush():
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined and stack[-1].role != HIDDEN:
                found.append((stack[-1].role, stack[-1].doubt, stack[-1].path, joined))

    def close(node):
        if node.role != HIDDEN and node.children:
            styles.append((node.path, xxhash.xxh3_64_intdigest(" ".join(node.children)) >> 1))

    def pop_to(k):
        while len(stack) > k:
            close(stack.pop())

    at, size, find = 0, len(source), _TOKEN.search
    while at < size:
        m = find(source, at)
        if m is None:
            tail = source[at:]
            text.append(tail if "<" not in tail else tail[: tail.rfind("<")] if re.match(r"<[a-zA-Z!/?]", tail[tail.rfind("<") :]) else tail)
            break
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag in BLOCK:
                        flush()
                    pop_to(k)
                    break
                if stack[k].tag in MAIN_TAGS and tag not in ("html", "body", "main", "article", "section", "div"):
                    k = 0
                    break
            else:
                k = 0
            if not k and tag == "p":  # without an open one, an empty paragraph
                flush()
            if tag == "br":
                text.append(" ")
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in BLOCK:
            flush()
        if tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in CLOSES:
            ends, limits = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in limits:
                    break
                if stack[k].tag in ends:
                    pop_to(k)
                    break
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            at = end.end() if end else size
            continue
        role, doubt, look = _role(tag, attributes)
        if tag == "body":
            for n in stack[1:]:
                if n.tag == "head":
                    pop_to(stack.index(n))
                    break
        above = stack[-1]
        if tag in BLOCK:
            above.children.append(look)
        path = above.path if tag not in BLOCK or tag in ("html", "body") else xxhash.xxh3_64_intdigest(look, above.path) >> 1
        stack.append(_Node(tag, _under(above.role, role), doubt or above.doubt, path))
    flush()
    pop_to(1)
    return found, styles


def host_of(url):
    """Host of a URL in lower case; null or odd URLs share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


PARSED = "page_id long, url string, host string, priors array<float>, paths array<long>, texts array<string>, page long, marks array<struct<path:long,kind:tinyint,mark:long,c:long>>"
#: Kinds of marks that a page leaves on a branch: a text in it, a layout of its children, its presence.
TEXT, LAYOUT, PRESENT = 0, 1, 2


def priors(found: list[tuple[int, bool, int, str]]) -> list[float]:
    """What the markup of a page's blocks says of them before the host's tree is asked."""
    roles = {r for r, _, _, _ in found}
    main = MAIN if MAIN in roles else INNER  # a main content inside noise counts where there is no other
    of = {main: 1.0, NEUTRAL: BESIDE if main in roles else 1.0, NOISE: ALONE if roles == {NOISE} else NAMED}
    return [of.get(r, NAMED) * (DOUBT if doubt else 1.0) for r, doubt, _, _ in found]


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Each page's blocks with priors and branches, and what it gives to the host's style tree. Column page is a digest."""
    mark = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.int8()), ("mark", pa.int64()), ("c", pa.int64())]))

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("priors", "paths", "texts", "page", "marks")}
            for source in b.column(3).to_pylist():
                found, styles = blocks(source)
                paths, texts = [p for _, _, p, _ in found], [t for _, _, _, t in found]
                seen = Counter((p, TEXT, xxhash.xxh3_64_intdigest(t) >> 1) for p, t in zip(paths, texts))
                held = set(paths)
                seen.update((p, LAYOUT, s) for p, s in styles if p in held)
                seen.update((p, PRESENT, 0) for p in held)
                out["priors"].append(priors(found))
                out["paths"].append(paths)
                out["texts"].append(texts)
                out["page"].append(xxhash.xxh3_64_intdigest(repr((paths, texts)).encode("utf-8", "surrogatepass")) >> 1)
                out["marks"].append([{"path": p, "kind": k, "mark": x, "c": c} for (p, k, x), c in seen.items()])
            kinds = (pa.list_(pa.float32()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), mark)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(v, t) for v, t in zip(out.values(), kinds))], ["page_id", "url", "host", *out])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, PARSED)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, importance) of the branches with text of their own that two pages of a host have, or more. Pages of a
    host with the same blocks count as one.

    Content: the mean over a branch's texts of 1 - H, where H is the entropy of a text's spread over the m pages that have
    the branch, to the base m: 0 for a text that all of them have alike, 1 for a text of one page. Presentation: the
    entropy, to the base m, of the ways in which its children are laid out. Importance is the larger of the two where a
    branch has both, drawn to UNSEEN as if UNSEEN_PAGES more pages had that. Everything is a sum by keys, so a large host
    is counted before it is shuffled."""
    once = pages.groupBy("host", "page").agg(F.first("marks").alias("marks"))
    g = once.select("host", F.explode("marks").alias("x")).select("host", "x.*")
    g = g.groupBy("host", "path", "kind", "mark").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.ln("c")).alias("s"))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    spread, n = F.avg(of(TEXT, F.ln("c") - F.col("s") / F.col("c"))), F.sum(of(LAYOUT, F.col("c")))
    laid_out = F.ln(n) - F.sum(of(LAYOUT, F.col("c") * F.ln("c"))) / n
    b = g.groupBy("host", "path").agg(F.max(of(PRESENT, F.col("c"))).alias("m"), spread.alias("spread"), laid_out.alias("layout")).where("m > 1")
    base = F.ln("m")
    measured = F.least(F.greatest(1 - F.col("spread") / base, F.coalesce(F.col("layout") / base, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return b.select("host", "path", ((measured * F.col("m") + UNSEEN * UNSEEN_PAGES) / (F.col("m") + UNSEEN_PAGES)).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = IMPORTANCE) -> DataFrame:
    """(id, url, text, n_chars) for each row: the main text, blocks in page order joined by one space.

    All pages of a host are merged into a style tree of presentations. A block stays if its prior times the importance of
    its branch is at least ``least``. The prior is what markup suggests (article and main, navigation, header, footer,
    form, advert, comments and so on); a branch of one page alone has the importance UNSEEN. What no page shows (scripts,
    styles, the head, hidden elements) is no text. Null html is empty and gives an empty text; rows that repeat an id are
    extracted one by one; null ids and URLs stay null; an empty table gives no rows."""
    tune(pages.sparkSession)
    made = materialize(parsed(pages, id_col, url_col, html_col), "parsed")
    tree = style_tree(made)
    # Branches that pages share are a host's templates. Written out, so that the optimizer knows their size and leaves the
    # texts where they are if it is small.
    told = materialize(tree.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "importance"))).alias("told")), "tree")
    judged = made.join(told, "host", "left")
    stays = F.filter(F.arrays_zip("priors", "paths", "texts"), lambda x: x["priors"].cast("double") * F.coalesce(F.try_element_at("told", x["paths"]), F.lit(UNSEEN)) >= F.lit(least))
    out = judged.select("page_id", "url", F.array_join(F.transform(stays, lambda x: x["texts"]), " ").alias("text"))
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
