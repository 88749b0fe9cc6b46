"""Connected components, and orientations that agree over shared edges."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node of the edges. Each round a node takes the smallest label around it, and then
    the label of that label, so the rounds grow with the logarithm of the longest way; a round is written. The joins are merges: compressed
    files of labels look small enough to be sent through the driver, and are not."""
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("label")).hint("merge"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("label"))
        hooked = cut(labels.join(near.hint("merge"), "node").select("node", F.least("component", "label").alias("component"), (F.col("label") < F.col("component")).alias("moved")), "labels")
        jumped = hooked.join(labels.select(F.col("node").alias("component"), F.col("component").alias("further")).hint("merge"), "component").select("node", F.least("component", "further").alias("component"), (F.col("moved") | (F.col("further") < F.col("component"))).alias("moved"))
        now = cut(jumped, "labels")
        more = now.where("moved").limit(1).count()
        release(labels, hooked)
        labels = now.drop("moved")
        if not more:
            return labels


def orientations(faces: DataFrame, corners: int = 3) -> DataFrame:
    """case_id, face_id, flip, component, closed, orientable: which faces to turn so that all of a component agree, and, if the component is
    closed, look outward. faces: case_id, face_id, x0, y0, z0, x1, ...; corners at the same place are one vertex.

    Two faces that share an edge agree if they run along it in opposite ways. Faces are nodes twice, as they are and turned; an
    edge ties either the same or the opposite states of its faces, so the two states of a face fall into two components of
    that graph, which are the two orientations of its surface, or, on a one-sided surface, into one. Of the two the one of positive
    enclosed volume is taken; on a surface with a border the one that turns fewer faces. Edges of more than two faces tie nothing.
    """
    # Nodes are numbers: twice the face's own, which is written, and one more if it is turned.
    faces = cut(faces.withColumn("number", F.monotonically_increasing_id()), "faces")
    at = [F.concat_ws(",", *[(F.col(f"{c}{k}") + 0.0).cast("string") for c in "xyz"]) for k in range(corners)]
    named = faces.select("case_id", "number", F.array(*at).alias("p"))
    sides = named.select("case_id", "number", F.explode(F.array(*[F.struct(F.col("p")[k].alias("s"), F.col("p")[(k + 1) % corners].alias("e")) for k in range(corners)])).alias("d"))
    sides = sides.where("d.s <> d.e").select("case_id", "number", F.least("d.s", "d.e").alias("lo"), F.greatest("d.s", "d.e").alias("hi"), (F.col("d.s") < F.col("d.e")).alias("up"))
    shared = sides.groupBy("case_id", "lo", "hi").agg(F.count("*").alias("n"), F.min(F.struct("number", "up")).alias("one"), F.max(F.struct("number", "up")).alias("two"))
    node = lambda face, turned: face * 2 + turned.cast("long")
    pairs = shared.where("n = 2 and one.number <> two.number").withColumn("apart", F.col("one.up") == F.col("two.up"))
    ties = pairs.select(F.explode(F.array(*[F.struct(node(F.col("one.number"), F.lit(t)).alias("a"), node(F.col("two.number"), F.col("apart") != F.lit(t)).alias("b")) for t in (False, True)])).alias("x")).select("x.*")
    alone = faces.select(F.explode(F.array(*[node(F.col("number"), F.lit(t)) for t in (False, True)])).alias("a")).withColumn("b", F.col("a"))
    found = components(ties.unionByName(alone)).select(F.floor(F.col("node") / 2).alias("number"), (F.col("node") % 2 == 1).alias("turned"), "component")
    # The two states of a face; the surface is named by the smaller of their components.
    both = found.groupBy("number").agg(F.min("component").alias("component"), F.max("component").alias("other"), F.max(F.when(~F.col("turned"), F.col("component"))).alias("as_is"))
    both = both.withColumns({"orientable": F.col("component") != F.col("other"), "state": F.col("as_is") != F.col("component")})
    border = sides.join(shared.where("n <> 2").select("case_id", "lo", "hi").hint("merge"), ["case_id", "lo", "hi"]).select("number").distinct().withColumn("border", F.lit(True))
    a, b, c = ([F.col(f"{x}{k}") for x in "xyz"] for k in range(3))
    volume = sum((a[i] * (b[j] * c[k] - b[k] * c[j]) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))), F.lit(0.0)) / 6
    told = faces.select("case_id", "face_id", "number", volume.alias("volume")).join(both.hint("merge"), "number").join(border.hint("merge"), "number", "left")
    signed = F.when(F.col("state"), -F.col("volume")).otherwise(F.col("volume"))
    surface = told.groupBy("component").agg(
        F.sum(signed).alias("inside"), (F.count("border") == 0).alias("closed"), F.count_if("state").alias("turned"), F.count("*").alias("n"), F.min(F.struct("face_id", "state")).alias("least"))
    # Where neither tells (no volume, or as many faces one way as the other), the first face stays.
    turned = F.when(F.col("least.state"), F.col("n") - F.col("turned")).otherwise(F.col("turned"))
    invert = F.when(F.col("closed") & (F.col("inside") != 0), F.col("inside") < 0).when(F.col("closed"), F.col("least.state")).otherwise((turned * 2 > F.col("n")) != F.col("least.state"))
    out = told.join(surface.select("component", "closed", invert.alias("invert"), F.col("least.face_id").alias("first")).hint("merge"), "component")
    return out.select("case_id", "face_id", (F.col("orientable") & (F.col("state") != F.col("invert"))).alias("flip"), F.col("first").alias("component"), "closed", "orientable")


def oriented(faces: DataFrame) -> DataFrame:
    """The triangles with their corners in the order that orientations() asks for."""
    told = orientations(faces).select("case_id", "face_id", "flip")
    d = faces.join(told.hint("merge"), ["case_id", "face_id"])
    new = {f"{c}{k}": F.when(F.col("flip"), F.col(f"{c}{o}")).otherwise(F.col(f"{c}{k}")) for c in "xyz" for k, o in ((1, 2), (2, 1))}
    return d.withColumns(new).select(faces.columns)


