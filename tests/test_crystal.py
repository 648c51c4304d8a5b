"""Crystal files and their graphs: known lattices, and a loop over images."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from lodeworks.operators import crystal
from lodeworks.sources import tabular

SCHEMA = "id string, lengths array<double>, angles array<double>, atoms array<struct<element: string, x: double, y: double, z: double>>"
FCC = [(0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0)]


def table(spark, *rows):
    return spark.createDataFrame([(n, list(map(float, a)), list(map(float, g)), [("X", *map(float, p)) for p in atoms]) for n, a, g, atoms in rows], SCHEMA)


def test_degrees_of_known_lattices(spark):
    square = (90, 90, 90)
    diamond = FCC + [tuple(v + 0.25 for v in p) for p in FCC]
    df = table(spark, ("cubic", (1, 1, 1), square, [(0, 0, 0)]), ("fcc", (2**0.5,) * 3, square, FCC), ("primitive", (1, 1, 1), (60, 60, 60), [(0, 0, 0)]), ("diamond", (4 / 3**0.5,) * 3, square, diamond), ("flat", (1, 1, 1), (90, 90, 0), [(0, 0, 0)]))
    edges = crystal.neighbour_edges(df, "id", 1.05)
    degree = {(r["id"], r["src"]): r["count"] for r in edges.groupBy("id", "src").count().collect()}
    assert degree == {("cubic", 0): 6, **{("fcc", i): 12 for i in range(4)}, ("primitive", 0): 12, **{("diamond", i): 4 for i in range(8)}}
    numbered = spark.createDataFrame([(r["id"], r["src"], r["dst"], i) for i, r in enumerate(edges.where("id = 'diamond'").collect())], "id string, src int, dst int, bond long")
    assert crystal.line_graph(numbered, "id", "bond").count() == 32 * 4  # 32 bonds, each with the four of the atom that it leads to


def test_neighbours_equal_a_loop_over_images(spark):
    rng = np.random.default_rng(3)
    atoms, lengths, angles, cutoff = rng.uniform(-0.7, 1.6, (5, 3)), (3.1, 4.0, 2.6), (80, 105, 97), 3.4
    row = table(spark, ("t", lengths, angles, atoms)).select(crystal.lattice(F.col("lengths"), F.col("angles")).alias("l")).first()["l"]
    cell = np.array([[row["ax"], 0, 0], [row["bx"], row["by"], 0], [row["cx"], row["cy"], row["cz"]]])
    assert np.allclose(np.linalg.norm(cell, axis=1), lengths) and np.isclose(cell[1] @ cell[2], 4.0 * 2.6 * np.cos(np.radians(80)))
    wanted = {}
    for i, j in itertools.product(range(5), repeat=2):
        for image in itertools.product(range(-6, 7), repeat=3):
            d = np.linalg.norm((atoms[j] + image - atoms[i]) @ cell)
            if d <= cutoff and (i != j or any(image)):
                wanted[i, j, image] = d
    got = {(r["src"], r["dst"], tuple(r["image"])): r["distance"] for r in crystal.neighbour_edges(table(spark, ("t", lengths, angles, atoms)), "id", cutoff).collect()}
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in wanted)


def test_atom_sites_of_a_file(spark, tmp_path):
    (tmp_path / "salt.cif").write_text(
        "data_NaCl\n_cell_length_a 5.64\n_cell_length_b 5.64\n_cell_length_c 5.64\n_cell_angle_alpha 90\n_cell_angle_beta 90\n_cell_angle_gamma 90\n"
        "loop_\n_symmetry_equiv_pos_as_xyz\n'x, y, z'\nloop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\nNa1 Na 0 0 0\n# a remark\nCl1 Cl 0.5(2) .5 5e-1\nX1 X ? 0 0\nloop_\n_other\n1\n"
    )
    (tmp_path / "empty.cif").write_text("data_none\n")
    rows = {r["cif_id"]: r for r in tabular.read_structures(spark, str(tmp_path)).collect()}
    assert [tuple(a) for a in rows["salt"]["atoms"]] == [("Na", 0, 0, 0), ("Cl", 0.5, 0.5, 0.5), ("X", None, 0, 0)] and rows["empty"]["atoms"] is None
    edges = crystal.neighbour_edges(tabular.read_structures(spark, str(tmp_path)), "cif_id", 5.0)
    assert edges.count() == 16  # the two ions, eight each along the diagonals
