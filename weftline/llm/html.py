"""Operator 5: main text of HTML pages by wrappers inferred from the pages of their host.

Tasks align the pages they read to one wrapper a host, and the partial wrappers are merged by host in two steps.  The
whole host's wrapper then says which part holds the varying prose and which texts are the template's; every page is
aligned to it once more and gives the texts of that part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh, table
from weftline.llm.wrapper import TEMPLATE_PAGES, Node, add_page, choose, extract, fold, pack, read, texts_of, unpack
from weftline.scratch import materialise, small_enough

#: Wrappers a task holds before it hands them on, and pages of a host that one task takes where wrappers are shuffled.
HOSTS, PAGES = 5_000, 20_000


def host_of(url: str) -> Column:
    """Host of a URL in lower case, without port; null if there is none."""
    host = F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def infer_wrappers(pages: DataFrame, template_pages: int = TEMPLATE_PAGES) -> DataFrame:
    """(host, wrapper) from rows of (host, html): every page takes part.

    A host's partial wrappers, one a task, are merged by parts and then as a whole, so that no merge takes more than
    about the square root of the number of tasks.  A wrapper is of bounded size whatever its pages."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Node] = {}

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([pack(w) for w in held.values()])], ["host", "wrapper"])
            held.clear()
            return out

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[host] = add_page(held.get(host), fold(read(html)))
                if len(held) >= HOSTS:
                    yield hand_on()
        if held:
            yield hand_on()

    def merged(part: pa.Table) -> Node:
        whole = None
        for text in sorted(part.column("wrapper").to_pylist()):
            whole = add_page(whole, unpack(text))
        return whole

    def step(part: pa.Table) -> pa.Table:
        return pa.table({"host": part.column("host").slice(0, 1), "wrapper": [pack(merged(part))]})

    def last(part: pa.Table) -> pa.Table:
        return pa.table({"host": part.column("host").slice(0, 1), "wrapper": [pack(choose(merged(part), template_pages))]})

    some = materialise(pages.where("host is not null and html is not null").mapInArrow(partial, "host string, wrapper string"))
    most = some.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    parts = some.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(math.ceil(math.sqrt(most)))))
    return parts.groupBy("host", "part").applyInArrow(step, "host string, wrapper string").groupBy("host").applyInArrow(last, "host string, wrapper string")


def article(html: str | None, wrapper: Node | None, template_pages: int = TEMPLATE_PAGES) -> str:
    """The texts that the wrapper keeps, joined by one space.  A page that has nothing of what its host's wrapper
    keeps, or no host, is its own wrapper; if even that keeps nothing, what no mark calls an aside is taken."""
    if not html:
        return ""
    page = read(html)
    found = extract(page, wrapper) if wrapper else []
    if not found:
        own = fold(page)
        found = extract(page, choose(own, template_pages)) or [t for k in page.kids for t in texts_of(k)]
    return " ".join(t.value for t in found)


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_name: str = "text", length_name: str = "n_chars", template_pages: int = TEMPLATE_PAGES, by_shuffle: bool = False) -> DataFrame:
    """``pages`` with the article's text and its length in code points.

    Null and empty pages give an empty text.  A page whose URL has no host is a wrapper of its own.  A text counts as
    the template's where it stands unchanged in its place on all of at least ``template_pages`` pages of the host; on
    fewer there is no telling.  Malformed pages are read as far as they go, in time linear in their length; nesting
    beyond 48 levels is borne without a level of its own.  Rows that repeat give equal texts.  Columns of the new
    names are replaced, others stay whatever their names.  An empty table gives no rows.

    Wrappers are broadcast only below the engine's bounds; beyond (or with ``by_shuffle``) pages and wrappers are
    dealt by host, the pages of a large host over several tasks.
    """
    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    wrappers = materialise(infer_wrappers(rows, template_pages))
    keep = [c for c in pages.columns if c not in (text_name, length_name)]
    host, text = fresh(pages, "host", "text")
    out = pages.withColumn(host, host_of(url_col))
    if by_shuffle or not small_enough(wrappers):
        out = _by_shuffle(out, wrappers, host, html_col, text, template_pages)
    else:
        shared = pages.sparkSession.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in wrappers.toArrow().columns))))

        @F.pandas_udf("string")
        def of_page(html, own):  # noqa: ANN001, ANN202
            import pandas as pd

            ready: dict[str, Node] = {}
            found = []
            for page, name in zip(html, own):
                if isinstance(name, str) and name not in ready and name in shared.value:
                    ready[name] = unpack(shared.value[name])
                found.append(article(page if isinstance(page, str) else None, ready.get(name) if isinstance(name, str) else None, template_pages))
            return pd.Series(found, dtype=object)

        out = out.withColumn(text, of_page(F.col(html_col).cast("string"), F.col(host)))
    return out.select(*[out[c] for c in keep], out[text].alias(text_name), F.char_length(out[text]).cast("long").alias(length_name))


def _by_shuffle(pages: DataFrame, wrappers: DataFrame, host: str, html_col: str, text: str, template_pages: int) -> DataFrame:
    """``pages`` with the text: each task sees a host's wrapper first and then its share of the host's pages."""
    spread, wrapper, part = fresh(pages, "spread", "wrapper", "part")
    counts = pages.groupBy(F.col(host).alias("host")).agg(F.ceil(F.count("*") / PAGES).cast("int").alias("k"))
    large = {r["host"]: r["k"] for r in counts.where("k > 1 and host is not null").orderBy(F.desc("k")).limit(1000).collect()}
    k = F.coalesce(F.create_map(*[F.lit(v) for kv in large.items() for v in kv])[F.col(host)], F.lit(1)) if large else F.lit(1)
    mine = pages.withColumn(wrapper, F.lit(None).cast("string")).withColumn(part, F.pmod(F.xxhash64(html_col), k).cast("int"))
    known = wrappers.select(F.col("host").alias(host), F.col("wrapper").alias(wrapper)).withColumn(part, F.explode(F.sequence(F.lit(0), k - 1)))
    both = mine.unionByName(known, allowMissingColumns=True).repartition(host, part).sortWithinPartitions(host, part, F.col(wrapper).isNull())
    names = both.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, node = None, None
        for batch in batches:
            hosts, pages_of, given = (batch.column(names.index(c)).to_pylist() for c in (host, html_col, wrapper))
            rows, found = [], []
            for i, (h, page, w) in enumerate(zip(hosts, pages_of, given)):
                if w is not None:
                    now, node = h, unpack(w)
                else:
                    rows.append(i)
                    found.append(article(page, node if h is not None and h == now else None, template_pages))
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string())], [*names, text])

    return both.mapInArrow(work, f"{kinds}, `{text}` string")


def op5_html(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages).select("page_id", "url", "text", "n_chars")
