"""Golden sales: what each set of lines must become."""

import pytest
from pyspark.sql import functions as F

from plotline.fixed_values import SALE_LINE_COLUMNS
from plotline.functions import cleaning as c
from plotline.operators import consolidate as co

HOUSE = dict(
    date_mutation="2025-01-08", nature_mutation="Vente", valeur_fonciere="119500", adresse_nom_voie="SIBILOT",
    code_postal="23800", code_commune="23103", code_departement="23", id_parcelle="231030000A0095", nombre_lots="0",
    code_type_local="1", type_local="Maison", surface_reelle_bati="66", nombre_pieces_principales="3",
    code_nature_culture="S", surface_terrain="60", longitude="1.588795", latitude="46.349388",
)
BARE = dict(code_type_local="", type_local="", surface_reelle_bati="", nombre_pieces_principales="")
FLAT = dict(code_type_local="2", type_local="Appartement")
BOX = dict(code_type_local="3", type_local="Dépendance", surface_reelle_bati="", nombre_pieces_principales="")
SALES = {
    "M1": [{}, {**BARE, "id_parcelle": "P2", "surface_terrain": "666"}],
    "M2": [
        {**FLAT, "surface_reelle_bati": "65", "valeur_fonciere": "300000", "adresse_nom_voie": "12 RUE SAINT-JEAN"},
        {**BOX, "id_parcelle": "CAVE"}, {**BOX, "id_parcelle": "BOX"},
    ],
    "M3": [
        {**FLAT, "surface_reelle_bati": "40", "nombre_pieces_principales": "2", "id_parcelle": "P1", "valeur_fonciere": "400000"},
        {**FLAT, "surface_reelle_bati": "60", "nombre_pieces_principales": "3", "id_parcelle": "P2", "valeur_fonciere": "400000"},
    ],
    "M4": [{"surface_reelle_bati": "90"}, {**FLAT, "surface_reelle_bati": "50"}],
    "M5": [{"surface_reelle_bati": "99", "valeur_fonciere": "125000,00"}] * 2,
    "M6": [{"nature_mutation": "Echange"}],
    "M7": [BARE],
    "M8": [{"longitude": "", "latitude": ""}],
    "M9": [{"valeur_fonciere": "1"}],
    "M10": [{**FLAT, "surface_reelle_bati": "50", "valeur_fonciere": "1500000"}],
    "M11": [{"date_mutation": "08/01/2025"}],
    "C1": [{"surface_reelle_bati": "90"}, {"code_type_local": "4", "surface_reelle_bati": "120"}],
    "C2": [{"code_type_local": "4", "surface_reelle_bati": "120"}],
    "L1": [
        {**BARE, "id_parcelle": "A", "surface_terrain": "800", "valeur_fonciere": "120000"},
        {**BARE, "id_parcelle": "B", "surface_terrain": "20000", "code_nature_culture": "T", "valeur_fonciere": "120000"},
    ],
    "L2": [{**BARE, "code_nature_culture": "T", "surface_terrain": "5000"}],
    "L3": [{**BARE, "surface_terrain": "500", "valeur_fonciere": "50000"}],
    "L4": [BOX],
}


@pytest.fixture(scope="module")
def lines(spark):
    rows, order = [], 0
    for sale, changes in SALES.items():
        for change in changes:
            order += 1
            row = {**dict.fromkeys(SALE_LINE_COLUMNS, ""), **HOUSE, **change, "id_mutation": sale}
            rows.append(tuple(row[k] for k in SALE_LINE_COLUMNS) + (order,))
    schema = ", ".join(f"{k} string" for k in SALE_LINE_COLUMNS) + ", ord long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def built(lines):
    return {r.id_mutation: r for r in co.built_candidates(co.sale_facts(lines)).collect()}


@pytest.fixture(scope="module")
def land(lines):
    return {r.id_mutation: r for r in co.land_candidates(co.sale_facts(lines)).collect()}


@pytest.mark.parametrize(
    "sale, reason",
    [("M4", "multi_type"), ("M6", "nature_non_vente"), ("M7", "aucun_local_bati"), ("M8", "geolocalisation_absente"),
     ("M11", "date_invalide"), ("C1", "multi_type"), ("C2", "type_local_non_retenu"), ("M1", None), ("M9", None)],
)
def test_reject_reason(built, sale, reason):
    assert built[sale].reject_reason == reason


def test_house_with_garden(built):
    row = built["M1"]
    assert (row.surface_bati, row.valeur_fonciere, row.surface_terrain) == (66, 119500, 726)


def test_flat_with_outbuildings(built):
    row = built["M2"]
    assert (row.surface_bati, row.nb_locaux, row.nb_dependances, row.surface_terrain) == (65, 1, 2, 180)
    assert row.adresse_voie == "Rue Saint-Jean"


def test_units_of_one_type_add_up(built):
    row = built["M3"]
    assert (row.surface_bati, row.nb_pieces, row.nb_locaux, row.valeur_fonciere) == (100, 5, 2, 400000)


def test_repeated_line_counts_once(built):
    row = built["M5"]
    assert (row.surface_bati, row.nb_locaux, row.valeur_fonciere) == (99, 1, 125000)


@pytest.mark.parametrize("sale, mark", [("M9", "valeur_symbolique"), ("M10", "prix_hors_bornes"), ("M1", None)])
def test_outlier_mark(built, sale, mark):
    assert built[sale].exclusion_reason == mark


def test_mixed_land_is_marked(lines, land):
    row = land["L1"]
    assert (row.surface_terrain, row.nb_parcelles, row.exclusion_reason) == (20800, 2, "terrain_mixte")
    stored = co.land_sales(co.land_candidates(co.sale_facts(lines))).filter("id_mutation = 'L1'").first()
    assert float(stored.prix_m2) == 5.77 and stored.type_local == "terrain" and stored.surface_bati is None


def test_land_reject_and_exclusions(land):
    assert land["L2"].reject_reason == "nature_culture_non_retenue"
    assert land["L3"].reject_reason is None and land["L3"].exclusion_reason is None
    assert "L4" not in land and "M1" not in land


def test_line_order_does_not_change_the_result(lines, built):
    shuffled = co.built_candidates(co.sale_facts(lines.orderBy(F.rand(3)).repartition(7)))
    assert {r.id_mutation: r for r in shuffled.collect()} == built


def test_cleaning_rules(spark):
    df = spark.createDataFrame([("12abc", "2024-02-31", "RUE DE L'ÉGLISE SAINT-JEAN 3B"), (" -1,5 ", "2024-02-29", "4 bis Rue Haute ")],
                               "n string, d string, v string")
    rows = df.select(c.tolerant_number(F.col("n")).cast("double"), c.strict_date(F.col("d")).cast("string"), c.street_name(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [(None, None, "Rue De L'Église Saint-Jean 3b"), (-1.5, "2024-02-29", "Rue Haute")]
