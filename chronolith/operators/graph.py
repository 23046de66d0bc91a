"""Forests of earlier-to-later links: roots, components, hubs, subgraphs, exports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.operators.prefix import BUCKET_ROWS, running_before
from chronolith.shared import scratch, stored


def _written(df: DataFrame) -> DataFrame:
    return stored(df, "forest")


def roots(nodes: DataFrame, edges: DataFrame, most: int = 40) -> DataFrame:
    """id, root of every node; a node without an edge is its own. Every child has one parent, which is earlier.

    Links first meet in ranges of their children, and a task follows each chain to its end or out of its range. Only the nodes
    where chains leave a range go on to pointer jumping, whose rounds double the distance and are written to the shared folder.
    """
    spark, kind = nodes.sparkSession, dict(edges.dtypes)["child"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // BUCKET_ROWS))

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # a range of narrow rows
        if not held:
            return
        links = pa.Table.from_batches(held).sort_by("child")
        child, top = (links.column(c).to_numpy() for c in ("child", "parent"))
        for _ in range(most if len(child) else 0):
            at = np.minimum(np.searchsorted(child, top), len(child) - 1)
            far = np.where(child[at] == top, top[at], top)
            if (far == top).all():
                break
            top = far
        yield pa.RecordBatch.from_arrays([pa.array(x, held[0].schema.field("child").type) for x in (child, top)], names=["id", "root"])

    links = edges.select("child", F.col("parent").cast(kind).alias("parent")).repartitionByRange(ranges, "child")
    with scratch(spark):
        near = _written(links.mapInArrow(followed, f"id {kind}, root {kind}"))
        up = _written(near.join(near.select(F.col("root").alias("id")).distinct(), "id", "left_semi"))
        for _ in range(most):
            far = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
            moved = _written(up.join(far, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.coalesce(F.col("next") != F.col("root"), F.lit(False)).alias("moved")))
            up = moved.select("id", "root")
            if moved.filter("moved").isEmpty():
                break
        else:
            raise RuntimeError(f"links deeper than 2**{most}, or a cycle")
        far = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
        whole = near.join(far, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
        return stored(nodes.select("id").join(whole, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "forest", keep=True)


def components(labelled: DataFrame, least: int = 1) -> DataFrame:
    """root, size, index: components of `least` nodes and more by falling size, ties to the smallest root."""
    sizes = labelled.groupBy("root").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    numbered = running_before(sizes.withColumn("one", F.lit(1)).withColumn("turn", -F.col("size")), ["turn", "root"], "one", "index")
    return numbered.select("root", "size", F.col("index").cast("int").alias("index"))


def hubs(labelled: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """root, id, children, place: the k nodes of each component with most children."""
    degree = edges.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    w = Window.partitionBy("root").orderBy(F.desc("children"), "id")
    return labelled.join(degree, "id").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in keep(id)."""
    return edges.join(keep.select(F.col("id").alias("child")), "child", "left_semi").join(keep.select(F.col("id").alias("parent")), "parent", "left_semi")


def faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts that must all be 0: repeated ids, ends that are no node, links that do not go forward.

    Ids and ends are counted together, those of one task before they are sent; an end without an id is no node.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    seen = nodes.select("id", one.alias("node"), none.alias("end"), none.alias("back"))
    ends = F.inline(F.array(F.struct(F.col("child").alias("id"), none.alias("node"), one.alias("end"), F.coalesce((F.col("parent") >= F.col("child")).cast("long"), none).alias("back")), F.struct(F.col("parent").alias("id"), none.alias("node"), one.alias("end"), none.alias("back"))))
    each = seen.unionByName(edges.select(ends)).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("node", "end", "back")])
    lost = F.when(F.col("id").isNull() | (F.col("node") == 0), F.col("end")).otherwise(0)
    return each.agg(F.count_if(F.col("node") > 1).alias("repeated"), *[F.coalesce(F.sum(c), none).alias(n) for c, n in ((lost, "dangling"), (F.col("back"), "backward"))])


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML file, with a sort key; written in order by write.text after repartitionByRange."""
    spark: SparkSession = nodes.sparkSession
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    attrs = [c for c in nodes.columns if c != "id"]
    kinds = {"string": "string", "bigint": "long", "int": "int", "double": "double"}
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="n_{c}" for="node" attr.name="{c}" attr.type="{kinds.get(dict(nodes.dtypes)[c], "string")}"/>' for c in attrs]
    head += [f'<key id="e_{c}" for="edge" attr.name="{c}" attr.type="double"/>' for c in ("cosine", "gap")] + ['<graph edgedefault="directed">']
    top = spark.createDataFrame([(0, str(k).zfill(4), x) for k, x in enumerate(head)], "part int, key string, line string")
    data = F.concat(*[F.concat(F.lit(f'<data key="n_{c}">'), esc(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</data>")) for c in attrs]) if attrs else F.lit("")
    body = nodes.select(F.lit(1).alias("part"), F.col("id").cast("string").alias("key"), F.concat(F.lit('<node id="'), esc(F.col("id").cast("string")), F.lit('">'), data, F.lit("</node>")).alias("line"))
    link = F.concat(F.lit('<edge source="'), F.col("parent").cast("string"), F.lit('" target="'), F.col("child").cast("string"), F.lit('"><data key="e_cosine">'), F.col("cosine").cast("string"), F.lit('</data><data key="e_gap">'), F.col("gap").cast("string"), F.lit("</data></edge>"))
    links = edges.select(F.lit(2).alias("part"), F.concat_ws("->", "parent", "child").alias("key"), link.alias("line"))
    end = spark.createDataFrame([(3, "0", "</graph></graphml>")], "part int, key string, line string")
    return top.unionByName(body).unionByName(links).unionByName(end)


def cytoscape_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, json: one element per row, as the elements of a Cytoscape file."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.struct(F.col("id").cast("string").alias("id"), *[c for c in nodes.columns if c != "id"]).alias("data"))).alias("json"))
    name = F.concat_ws("->", "parent", "child")
    e = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.struct(name.alias("id"), F.col("parent").cast("string").alias("source"), F.col("child").cast("string").alias("target"), "cosine", "gap").alias("data"))).alias("json"))
    return n.unionByName(e)


def link_groups(links: DataFrame, split: int = 2020) -> DataFrame:
    """scope, edges, same_family, mean_gap, cross_board of all links, of those until the year `split`, and of later ones.

    links: gap, year (of the child), same, across. A scope without links has no means.
    """
    early, late = F.col("year") <= split, F.col("year") > split
    scopes = F.explode(F.filter(F.array(F.lit("all"), F.when(early, F.lit("through_2020")), F.when(late, F.lit("2021_2022"))), lambda x: x.isNotNull()))
    every = links.sparkSession.createDataFrame([("all",), ("through_2020",), ("2021_2022",)], "scope string")
    mean = lambda c: F.round(F.avg(c), 6)
    made = links.withColumn("scope", scopes).groupBy("scope").agg(F.count("*").alias("edges"), mean(F.col("same").cast("int")).alias("same_family"), mean(F.col("gap")).alias("mean_gap"), mean(F.col("across").cast("int")).alias("cross_board"))
    return every.join(made, "scope", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))  # three names


def drift(chosen: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: chosen links (child, parent), how many are in the graph, have another parent there, or none."""
    now = chosen.join(edges.select("child", F.col("parent").alias("now")), "child", "left")
    return now.agg(F.count("*").alias("selected"), F.count_if(F.col("now") == F.col("parent")).alias("present"), F.count_if(F.col("now") != F.col("parent")).alias("other_parent"), F.count_if(F.col("now").isNull()).alias("gone"))


def profiles(members: DataFrame, edges: DataFrame, least: int = 3, k: int = 3) -> DataFrame:
    """index, root, size, first_year, last_year, earliest, boards, early, hubs of components of `least` members and more.

    members: root, id, year, subreddit, created_utc. boards: (subreddit, n) by name; early: the first k ids by time; hubs: (id,
    children) of the k with most children. Rows of a component never meet but for its counts and its first ones.
    """
    of = components(members, least)
    rows = members.join(of.select("root"), "root", "left_semi")
    spans = rows.groupBy("root").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("id", F.struct("created_utc", "id")).alias("earliest"))
    boards = rows.groupBy("root", "subreddit").agg(F.count("*").alias("n")).groupBy("root").agg(F.sort_array(F.collect_list(F.struct("subreddit", "n"))).alias("boards"))
    first = rows.withColumn("no", F.row_number().over(Window.partitionBy("root").orderBy("created_utc", "id"))).filter(F.col("no") <= k)
    early = first.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "id"))), lambda x: x["id"]).alias("early"))
    most = hubs(rows.select("root", "id"), edges, k).groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id", "children"))), lambda x: F.struct(x["id"].alias("id"), x["children"].alias("children"))).alias("hubs"))
    return of.join(spans, "root").join(boards, "root").join(early, "root").join(most, "root")
