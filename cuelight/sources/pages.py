"""Scraped pages and graph documents: episode links, download boxes, episode ids."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_EPISODE = re.compile(r"versions-\d+-(\d+)-(\d+)-[\w-]+-subtitles")


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and "list-group-item" in (a.get("class") or "").split() and "-subtitles" in (a.get("href") or ""):
            self.found.append(a["href"])


@udtf(returnType="pos int, season int, episode int, url string")
class EpisodeLinks:
    """Links to episodes on a show's page, in page order."""

    def eval(self, html: str, base_url: str):
        parser = _Anchors()
        parser.feed(html or "")
        for pos, href in enumerate(parser.found):
            m = _EPISODE.search(href)
            if m:
                yield pos, int(m[2]), int(m[1]), urljoin(base_url, href)


class _Boxes(HTMLParser):
    """Text, version and download link of each result box."""

    def __init__(self, style: str):
        super().__init__()
        self.style, self.stack, self.boxes = style, [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "div" and self.style in (a.get("style") or "") and not any(t == "box" for t, _ in self.stack):
            self.boxes.append({"text": [], "version": None, "href": None})
            self.stack.append(("box", tag))
            return
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            return
        names = (a.get("class") or "").split()
        kind = "version" if {"version", "version-hearing"} & set(names) else "i" if tag == "i" and any(t == "version" for t, _ in self.stack) else ""
        self.stack.append((kind, tag))
        if self.boxes and any(t == "box" for t, _ in self.stack) and tag == "a" and (a.get("href") or "").startswith("/downloads/"):
            self.boxes[-1]["href"] = self.boxes[-1]["href"] or a["href"]

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][1] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        kinds = [t for t, _ in self.stack]
        if "box" in kinds and data.strip():
            self.boxes[-1]["text"].append(data.strip())
            if "i" in kinds and self.boxes[-1]["version"] is None:
                self.boxes[-1]["version"] = data.strip()


@udtf(returnType="pos int, version string, url string, downloads int")
class DownloadBoxes:
    """Download boxes of a language on an episode's page."""

    def eval(self, html: str, language: str, base_url: str):
        parser = _Boxes("background-color: #f5f5f5")
        parser.feed(html or "")
        for pos, box in enumerate(parser.boxes):
            text = " ".join(box["text"])
            if re.search(rf"Language : {{1,2}}{re.escape(language)}", text) and box["href"]:
                count = re.search(r"Downloads\s*:\s*(\d+)", text)
                yield pos, box["version"] or "unknown", urljoin(base_url, box["href"]), int(count[1]) if count else 0


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(by)).filter("_place = 1").drop("_place")


def _per_page(rows, names: list[str], types: list[pa.DataType]):
    """A function for mapInArrow(): for each page the tuples that rows(html) yields, beside its page_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], []
            for k, html in enumerate(batch.column("html").to_pylist()):
                for row in rows(html):
                    of.append(k)
                    found.append(row)
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["page_id", *names])

    return run


def episode_links(pages: DataFrame, base_url: str) -> DataFrame:
    """(page_id, season, episode, url) of pages(page_id, html): the first link of each episode."""
    rows = lambda html: EpisodeLinks.func().eval(html, base_url)
    read = _per_page(rows, ["pos", "season", "episode", "url"], [pa.int32(), pa.int32(), pa.int32(), pa.string()])
    found = pages.select("page_id", "html").mapInArrow(read, f"page_id {pages.schema['page_id'].dataType.simpleString()}, pos int, season int, episode int, url string")
    return first_wins(found, ["page_id", "season", "episode"], ["pos"]).select("page_id", "season", "episode", "url")


def best_download(pages: DataFrame, language: str, base_url: str) -> DataFrame:
    """(page_id, version, url, downloads) of the most downloaded box of a language; the first of equals."""
    rows = lambda html: DownloadBoxes.func().eval(html, language, base_url)
    read = _per_page(rows, ["pos", "version", "url", "downloads"], [pa.int32(), pa.string(), pa.string(), pa.int32()])
    found = pages.select("page_id", "html").mapInArrow(read, f"page_id {pages.schema['page_id'].dataType.simpleString()}, pos int, version string, url string, downloads int")
    return first_wins(found, ["page_id"], [F.desc("downloads"), "pos"]).select("page_id", "version", "url", "downloads")


# A graph document is JSON whose nodes refer to each other. A reference names the path of its target from the
# document's root, an atom wraps a value, and a list is an array, an atom-like wrapper of one, or an object with numbered
# members. The expressions below work on VARIANT values within one row, so that no join and no Python is needed.


def _member(node: str, name: str, kind: str = "variant") -> str:
    return f"""try_variant_get({node}, '$["{name}"]', '{kind}')"""


def _target(graph: str, node: str) -> str:
    """What a reference refers to; any other node itself."""
    steps = _member(node, "value", "array<string>")
    path = f"""concat('$', array_join(transform({steps}, step -> concat('["', step, '"]')), ''))"""
    return f"if({_member(node, '$type', 'string')} <=> 'ref', try_variant_get({graph}, {path}, 'variant'), {node})"


def _is_object(node: str) -> str:
    return f"startswith(schema_of_variant({node}), 'OBJECT')"


def _scalar(node: str) -> str:
    """A value as text, out of its atom if it has one."""
    return f"if({_is_object(node)}, {_member(node, 'value', 'string')}, try_variant_get({node}, '$', 'string'))"


def _items(graph: str, node: str) -> str:
    """The nodes of a list, in order."""
    numbered = f"filter(map_entries(try_variant_get(it, '$', 'map<string, variant>')), m -> m.key RLIKE '^[0-9]+$')"
    ordered = f"transform(array_sort({numbered}, (x, y) -> CAST(x.key AS INT) - CAST(y.key AS INT)), m -> m.value)"
    listed = f"coalesce({_member('it', 'values', 'array<variant>')}, try_variant_get(it, '$', 'array<variant>'), {ordered}, array())"
    return f"get(transform(array({_target(graph, node)}), it -> {listed}), 0)"


def _identity(graph: str, node: str) -> str:
    """The id of the node that is meant, of the reference to it otherwise."""
    return f"get(transform(array({node}), n -> coalesce({_scalar(_member(_target(graph, 'n'), 'id'))}, {_scalar(_member('n', 'id'))})), 0)"


def graph_episodes(document: str, show_id: str) -> str:
    """SQL of an array of (season, episode, video_id): the episode ids of a show in a graph document, both SQL too.

    Seasons and episodes are numbered from 1 by their places. A season is the video that its id names, or else what its
    entry refers to; a bare value in the list of seasons is an id. Entries without an id, and episodes that are bare
    values, keep their place but give no row. Null and malformed documents give none.
    """
    seasons = _items("g", "show_seasons")
    episode = f"if({_is_object('item')}, {_identity('g', 'item')}, NULL)"
    block = f"""coalesce(try_variant_get(g, concat('$["videos"]["', own, '"]'), 'variant'), {_target('g', 'entry')})"""
    rows = f"transform({_items('g', _member(block, 'episodes'))}, (item, e) -> named_struct('season', s + 1, 'episode', e + 1, 'video_id', {episode}))"
    own = f"coalesce({_identity('g', 'entry')}, if({_is_object('entry')}, NULL, {_scalar('entry')}))"
    per_season = f"get(transform(array({own}), own -> if(own IS NULL, array(), {rows})), 0)"
    of_show = f"""get(transform(array(try_variant_get(g, concat('$["videos"]["', {show_id}, '"]["seasonList"]["seasons"]'), 'variant')), show_seasons -> {seasons}), 0)"""
    found = f"flatten(transform({of_show}, (entry, s) -> {per_season}))"
    return f"get(transform(array(try_parse_json({document})), g -> filter({found}, r -> r.video_id IS NOT NULL)), 0)"


def walk_graph(documents: DataFrame, show_id: str) -> DataFrame:
    """(season, episode, video_id) of documents(document); see graph_episodes()."""
    escaped = show_id.replace("\\", "\\\\").replace("'", "\\'")
    return documents.select(F.explode(F.expr(graph_episodes("document", f"'{escaped}'"))).alias("r")).select("r.season", "r.episode", "r.video_id")
