"""Main text of web pages: runs that a host repeats, with page structure as their guard.

Every page becomes a stream of text blocks, each inside an article or main element,
inside a frame (navigation, notices and the like) or in neither. Long runs of tokens
that recur outside articles on a share of a host's distinct pages are boilerplate;
they are counted over the whole host, whatever its size. What a frame holds is left
out; of the rest, tokens under boilerplate go and each page's unique runs stay.

Structure guards what the runs may remove. Two pages of one host may carry the same
article, or share a quoted passage, and those are long repeated runs as well: so runs
inside articles do not count, and a block of an article goes only if it is, as a
whole, one that the host repeats outside articles. Where a page has an article or
main element, blocks outside it are no part of its text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarewatch.llm.common import FILTER_BITS, bit_filter, checkpoint, passes, written

#: Tokens that a repeated block must have to be boilerplate.
RUN = 4
#: Tokens that a repeated run inside a longer block must have.
LONG_RUN = 12
#: Distinct pages, of differing content, on which it must occur outside articles, and their share of the host's.
PAGES, SHARE = 2, 0.1
#: Parts over which the pages that hold one frequent run are dealt.
SALTS = 16

#: A tag or comment. A quote that nothing closes is a character like others, so that each
#: tag is read once and the time is linear in the page.
_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<[A-Za-z/!?](?:[^>"']|"[^"]*"|'[^']*')*+[^>]*>?""", re.S)
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_MARK = re.compile(r"""\s(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\s(?:hidden(?=[\s>/=])|aria-hidden\s*=\s*["']?true)""", re.I)
_PART = re.compile(r"[A-Za-z0-9]+")

#: Elements whose content is not text at all; it ends at their end tag, whatever it holds.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title".split())
#: Elements that frame a page or take input.
CHROME = frozenset("nav aside footer form button select menu dialog head datalist fieldset".split())
#: Words in class, id or role that mark such a frame, and words that may stand beside them in one name.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert alertdialog popup modal overlay dialog newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead "
    "footer comment comments respond disqus share sharing social related recommended widget toolbar pagination pager login search skip hidden "
    "complementary contentinfo form".split()
)
NEUTRAL_WORDS = frozenset(
    "site page global top bottom left right main primary secondary post posts entry article articles blog box wrap wrapper container area list bar block "
    "section panel inner outer item items link links button buttons content unit body group row slot zone text title header reader user reply replies "
    "thread the and to all bg mobile desktop small large sticky fixed".split()
)
#: Words of running text from which a form is a page that stands in a form.
FORM_PROSE = 60
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside menu dialog".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new block ends when they were left open.
LOOSE = frozenset("p li dt dd tr td th option".split())


def _is_frame_name(name: str) -> bool:
    """Whether a class, id or role says that its element is a frame.

    Every part of the name must be a word for frames or a neutral one: ``site-footer`` is
    one, ``no-sidebar``, ``comments-closed`` and ``share-price`` say something else.
    """
    parts = [w.lower() for w in _PART.findall(name)]
    return any(w in CHROME_WORDS for w in parts) and all(w in CHROME_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in parts)


def _is_chrome(name: str, tag: str, in_main: bool) -> bool:
    if name in CHROME or (name == "header" and not in_main):
        return True
    if name in ("html", "body", "article", "main") and "comment" not in tag:
        return False
    if "=" not in tag and "hidden" not in tag:
        return False
    for m in _MARK.finditer(tag):
        if any(map(_is_frame_name, (m[2] or m[3] or m[4] or "").split())):
            return True
    return bool(_HIDDEN.search(tag))


#: Where a block stands: in an article or main element, in neither, or in a frame.
MAIN, PLAIN, FRAME = 0, 1, 2
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def page_blocks(page: str) -> list[tuple[str, int]]:
    """Text blocks in page order, each with its place: MAIN, PLAIN or FRAME.

    Character references are decoded, white space in a block is one blank, empty
    blocks are left out. One pass over the tags; unclosed elements end with the
    block that holds them or with the page. A frame that turns out to hold an article
    or main element is none, nor is a form of FORM_PROSE words of text in paragraphs:
    what it has held so far is as plain as what is outside.
    """
    out: list[tuple[str, int]] = []
    open_block: list[str] = []
    framed: list[str] = []  # text of the frame that is open
    skip_name, skip_depth = "", 0  # inside a frame: its element and how deeply nested
    since, prose, last = 0, 0, ""  # its first block, words of paragraphs in a form, the block element before
    main: list[str] = []

    def flush(parts: list[str], place: int) -> None:
        if text := " ".join("".join(parts).split()):
            out.append((text, place))
        parts.clear()

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            (framed if skip_depth else open_block).append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[0]
        named = _NAME.match(tag)
        if not named:
            continue
        name, closing = named[1].lower(), tag[1] == "/"
        if name in RAW:
            if not closing and not tag.endswith("/>"):
                end = _END[name].search(page, at)
                at = end.start() if end else len(page)
            continue
        if skip_depth:
            if name in BLOCKS:
                if skip_name == "form" and last == "p":
                    prose += len("".join(framed).split())
                flush(framed, FRAME)
                last = "" if closing else name
            if not closing and (name in ("article", "main") and skip_name not in ("nav", "aside", "footer", "dialog") and "comment" not in tag or prose >= FORM_PROSE):
                out[since:] = [(text, MAIN if main else PLAIN) for text, _ in out[since:]]
                skip_depth = 0
        if skip_depth:
            if name == skip_name:
                skip_depth += -1 if closing else (0 if tag.endswith("/>") else 1)
                if not closing and name in LOOSE:
                    skip_depth = 0  # a frame left open ends where its like begins
            elif skip_name in LOOSE and name in BLOCKS and (closing or name not in LOOSE):
                skip_depth = 0
            if skip_depth:
                continue
            flush(framed, FRAME)
            if closing and name == skip_name:
                continue
        if name in BLOCKS:
            flush(open_block, MAIN if main else PLAIN)
        elif name == "br":
            open_block.append(" ")
        if closing:
            if main and name == main[-1]:
                main.pop()
        elif name not in VOID and not tag.endswith("/>") and _is_chrome(name, tag, bool(main)):
            skip_name, skip_depth, since, prose, last = name, 1, len(out), 0, ""
        elif name in ("article", "main"):
            main.append(name)
    if at < len(page):
        (framed if skip_depth else open_block).append(html.unescape(page[at:]))
    flush(framed, FRAME)
    flush(open_block, MAIN if main else PLAIN)
    return out


def blocks_of(page: str) -> tuple[list[str], bool]:
    """Blocks that structure alone gives, and whether an article or main element names them."""
    found = page_blocks(page)
    if main := [text for text, place in found if place == MAIN]:
        return main, True
    return [text for text, place in found if place == PLAIN], False


def _mark(tokens: list[str]) -> int:
    """Hash of a run of tokens; runs of other lengths have other hashes."""
    text = " ".join(tokens).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(text, digest_size=8, person=b"run%d" % len(tokens)).digest(), "big", signed=True)


def windows_of(blocks: list[str]) -> list[tuple[int, int]]:
    """Hash and first token of every run that may be boilerplate.

    A block of RUN to LONG_RUN tokens is one run, a longer one has a run of LONG_RUN
    at each token. Tokens are numbered through the page; no run crosses a block.
    """
    out, at = [], 0
    for block in blocks:
        tokens = block.split()
        run = min(len(tokens), LONG_RUN)
        if run >= RUN:
            out += [(_mark(tokens[i : i + run]), at + i) for i in range(len(tokens) - run + 1)]
        at += len(tokens)
    return out


def without_runs(blocks: list[str], starts: list[int]) -> str:
    """Text of the blocks without the runs that begin at tokens ``starts``."""
    begin, kept, at = set(starts), [], 0
    for block in blocks:
        tokens = block.split()
        run = min(len(tokens), LONG_RUN)
        gone: set[int] = set()
        for i in range(len(tokens)):
            if at + i in begin:
                gone.update(range(i, i + run))
        if left := [w for i, w in enumerate(tokens) if i not in gone]:
            kept.append(" ".join(left))
        at += len(tokens)
    return "\n".join(kept)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each page, their places and a digest of both."""
    names = ["page_id", "url", "host", "blocks", "places", "content"]
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            few = batch.slice(low, 256)
            found = [page_blocks(p.as_py() or "") for p in few.column(3)]
            blocks, places = [[t for t, _ in b] for b in found], [[p for _, p in b] for b in found]
            digests = [_mark([f"{p} {t}" for t, p in b]) for b in found]
            columns = [pa.array(blocks, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int8())), pa.array(digests, pa.int64())]
            yield pa.RecordBatch.from_arrays([*few.columns[:3], *columns], names=names)


def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs and whole blocks outside articles, each once a page."""
    for batch in batches:
        for host, content, blocks, places in zip(*(c.to_pylist() for c in batch.columns)):
            outer = [b for b, p in zip(blocks, places) if p != MAIN]
            marks = {m for m, _ in windows_of(outer)} | {_mark(t) for b in outer if len(t := b.split()) >= RUN}
            if marks:
                columns = [pa.array([host] * len(marks), pa.string()), pa.array([content] * len(marks), pa.int64()), pa.array(list(marks), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["host", "content", "mark"])


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a page's text may lose: whole blocks of its article (start: minus block, less one), else runs."""
    for batch in batches:
        for host, content, blocks, places in zip(*(c.to_pylist() for c in batch.columns)):
            if MAIN in places:
                runs = [(_mark(t), -1 - i) for i, (b, p) in enumerate(zip(blocks, places)) if p == MAIN and len(t := b.split()) >= RUN]
            else:
                runs = windows_of([b for b, p in zip(blocks, places) if p == PLAIN])
            if runs:
                marks, starts = zip(*runs)
                columns = [pa.array([host] * len(runs), pa.string()), pa.array([content] * len(runs), pa.int64()), pa.array(marks, pa.int64()), pa.array(starts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["host", "content", "mark", "start"])


def _unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for blocks, places, starts in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            if MAIN in places:
                gone = {-1 - s for s in starts or []}
                texts.append("\n".join(b for i, (b, p) in enumerate(zip(blocks, places)) if p == MAIN and i not in gone))
            else:
                texts.append(without_runs([b for b, p in zip(blocks, places) if p == PLAIN], starts or []))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def repeated_runs(streams: DataFrame) -> DataFrame:
    """Where each distinct content has runs that its host repeats: host, content, starts.

    ``streams`` has host, content, blocks and places, and is written. Pages of equal
    content count as one, so a copied page is not boilerplate. Runs are counted over
    the whole host and outside articles only.
    """
    rows = streams.select("host", "content", "blocks", "places")
    once = rows.mapInArrow(_outside, "host string, content bigint, mark bigint").distinct()
    # a hot host's runs, and the pages that hold one run, would meet in one task
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    sizes = streams.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("n")).select("host", "n", salts)
    counted = once.groupBy("host", "mark").agg(F.count("*").alias("pages")).where(F.col("pages") >= PAGES)
    counted = counted.withColumn("salt", F.pmod("mark", F.lit(SALTS)).cast("int"))
    often = counted.join(sizes.hint("merge"), ["host", "salt"]).where(F.col("pages") >= F.col("n") * SHARE).select("host", "mark", salts)
    asking = rows.mapInArrow(_asking, "host string, content bigint, mark bigint, start int")
    salted = asking.withColumn("salt", F.pmod("content", F.lit(SALTS)).cast("int"))
    met = salted.hint("merge").join(often, ["host", "mark", "salt"])
    return met.groupBy("host", "content").agg(F.collect_set("start").alias("starts"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text (empty if none), n_chars.

    A null or empty html has no text. Pages are parsed once and written; they meet by
    host and run, never a host as a whole. A null url is one more host. Repeated rows
    are rows of their own; other columns are not read; no pages give no rows.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit("")))
    kept = pages.select("page_id", "url", host.alias("host"), "html")
    ddl = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string"
    streams = written(kept.mapInArrow(_streams, f"{ddl}, host string, blocks array<string>, places array<tinyint>, content bigint"))
    found = checkpoint(repeated_runs(streams))
    # only pages that may lose something meet their runs; the rest stay where they are
    bit = F.pmod(F.xxhash64("host", "content"), F.lit(FILTER_BITS))
    losing, columns = bit_filter(found, bit), ["page_id", "url", "blocks", "places"]
    out = f"{ddl}, text string"

    def pick(lose: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passes(losing.value, batch.column(batch.num_columns - 1).to_numpy()) == lose))

        return run

    kept = streams.select(*columns, F.lit(None).cast("array<int>").alias("starts"), bit.alias("bit"))
    kept = kept.mapInArrow(lambda batches: _unique_runs(pick(False)(batches)), out)
    some = streams.select(*columns, "host", "content", bit.alias("bit")).mapInArrow(pick(True), f"{ddl}, blocks array<string>, places array<tinyint>, host string, content bigint, bit bigint")
    some = some.hint("merge").join(found, ["host", "content"], "left").select(*columns, "starts").mapInArrow(_unique_runs, out)
    return kept.unionByName(some).withColumn("n_chars", F.length("text").cast("bigint"))
