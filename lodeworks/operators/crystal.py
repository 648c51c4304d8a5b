"""Graphs of crystals: atoms joined to their periodic neighbours, and bonds joined where they share an atom.

A structure is a row with an id, three lengths, three angles (degrees) and an array of atoms (element, x, y, z), in fractions of the cell. Structures of
any size are joins over atoms: every periodic image within reach falls into a box as wide as the cutoff, and an atom meets the images of its own box and
the 26 around it, so that no structure is ever one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.storage import materialised


def lattice(lengths: Column, angles: Column) -> Column:
    """(ax, bx, by, cx, cy, cz): the cell's vectors, the first along x and the second in the plane of x and y."""
    a, b, c = (lengths[i] for i in range(3))
    al, be, ga = (F.radians(angles[i]) for i in range(3))
    cy = c * (F.cos(al) - F.cos(be) * F.cos(ga)) / F.nullif(F.sin(ga), F.lit(0.0))
    cx = c * F.cos(be)
    return F.struct(a.alias("ax"), (b * F.cos(ga)).alias("bx"), (b * F.sin(ga)).alias("by"), cx.alias("cx"), cy.alias("cy"), F.sqrt(c * c - cx * cx - cy * cy).alias("cz"))


def neighbour_edges(structures: DataFrame, id_col: str, cutoff: float, lengths: str = "lengths", angles: str = "angles", atoms: str = "atoms") -> DataFrame:
    """(id, src, dst, image, distance): for each atom, by its place in the array, the atoms within ``cutoff``, in whichever image of the cell (three
    whole numbers); each bond both ways. Structures whose cell is incomplete or flat, and atoms with a missing coordinate, are left out."""
    cells = structures.select(F.col(id_col).alias("_id"), lattice(F.col(lengths), F.col(angles)).alias("l"), atoms)
    l = lambda c: F.col(f"l.{c}")  # noqa: E731, E741
    # Planes of the cell are this far apart; images beyond cutoff over that, and one more for fractions out of the cell, are out of reach.
    cross = lambda u, v: F.sqrt((u[1] * v[2] - u[2] * v[1]) ** 2 + (u[2] * v[0] - u[0] * v[2]) ** 2 + (u[0] * v[1] - u[1] * v[0]) ** 2)
    a, b, c = ((l("ax"), F.lit(0.0), F.lit(0.0)), (l("bx"), l("by"), F.lit(0.0)), (l("cx"), l("cy"), l("cz")))
    volume = l("ax") * l("by") * l("cz")
    reach = [F.ceil(F.lit(float(cutoff)) * cross(u, v) / F.nullif(volume, F.lit(0.0))).cast("int") + 1 for u, v in ((b, c), (a, c), (a, b))]
    whole = cells.where((volume > 1e-12) & ~F.isnan(volume)).select("_id", "l", F.array(*reach).alias("reach"), F.posexplode(atoms).alias("atom", "p"))
    # Fractions are moved into the cell; where an atom stood before is told by the image.
    home = [F.floor(F.col(f"p.{x}")).cast("int") for x in "xyz"]
    placed = whole.where("p.x is not null and p.y is not null and p.z is not null").select("_id", "l", "reach", "atom", F.array(*home).alias("home"), *[(F.col(f"p.{x}") - h).alias(f"f{x}") for x, h in zip("xyz", home)])
    placed = materialised(placed, "atoms")
    at = lambda fx, fy, fz: (fx * l("ax") + fy * l("bx") + fz * l("cx"), fy * l("by") + fz * l("cy"), fz * l("cz"))
    boxed = lambda xyz: [F.floor(v / float(cutoff)).cast("long") for v in xyz]
    shift = lambda i: F.explode(F.sequence(-F.col("reach")[i], F.col("reach")[i]))
    images = placed.withColumn("i", shift(0)).withColumn("j", shift(1)).withColumn("k", shift(2))
    xyz = at(F.col("fx") + F.col("i"), F.col("fy") + F.col("j"), F.col("fz") + F.col("k"))
    other = images.select("_id", F.col("atom").alias("dst"), F.array("i", "j", "k").alias("moved"), F.col("home").alias("home_dst"), *[v.alias(f"x{n}") for n, v in enumerate(xyz)], *[v.alias(f"b{n}") for n, v in enumerate(boxed(xyz))])
    own = at(F.col("fx"), F.col("fy"), F.col("fz"))
    around = placed.select("_id", F.col("atom").alias("src"), F.col("home").alias("home_src"), *[v.alias(f"y{n}") for n, v in enumerate(own)], *[v.alias(f"o{n}") for n, v in enumerate(boxed(own))])
    for n in range(3):
        around = around.withColumn(f"b{n}", F.explode(F.sequence(F.col(f"o{n}") - 1, F.col(f"o{n}") + 1)))
    met = around.join(other, ["_id", "b0", "b1", "b2"])
    distance = F.sqrt(sum(((F.col(f"x{n}") - F.col(f"y{n}")) ** 2 for n in range(3)), F.lit(0.0)))
    image = F.array(*[F.col("moved")[n] - F.col("home_dst")[n] + F.col("home_src")[n] for n in range(3)])
    itself = (F.col("src") == F.col("dst")) & (F.aggregate("moved", F.lit(0), lambda s, v: s + F.abs(v)) == 0)
    found = met.withColumn("distance", distance).where(~itself & (F.col("distance") <= cutoff))
    return found.select(F.col("_id").alias(id_col), "src", "dst", image.alias("image"), "distance")


def line_graph(edges: DataFrame, id_col: str, edge_col: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, one, other, atom): pairs of bonds, by their number ``edge_col``, of which the first leads to the atom that the second starts from; a bond and
    itself are no pair."""
    one = edges.select(F.col(id_col).alias("_id"), F.col(dst).alias("atom"), F.col(edge_col).alias("one"))
    other = edges.select(F.col(id_col).alias("_id"), F.col(src).alias("atom"), F.col(edge_col).alias("other"))
    return one.join(other, ["_id", "atom"]).where("one <> other").select(F.col("_id").alias(id_col), "one", "other", "atom")
