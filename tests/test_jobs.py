import pytest
from conftest import TESTDATA, rows
from pyspark.sql import functions as F

from panelforge import schemas
from panelforge.functions.hashing import hash_embed
from panelforge.operators import encoding, evaluation, joins
from panelforge.plans import catalog, jobs, testdata as td
from panelforge.sources import readers, snapshots, writers

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def posts_root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("posts") / "json")
    writers.write_json(td.stream_posts(spark, SF), root, partition_by=("ds",), compression=None)
    return root


def test_labelling_job_equals_the_queries_and_can_rerun(spark, posts_root, tmp_path):
    matched, labeled, ages, genders = (str(tmp_path / n) for n in ("matched", "labeled", "ages", "genders"))
    for _ in range(2):
        jobs.match_bios(spark, posts_root, matched, "2023-12-31", "2024-01-15")
        jobs.match_bios(spark, posts_root, matched, "2024-01-15", "2024-01-31")
        jobs.label_matched(spark, matched, labeled)
    stored = readers.read_json(spark, labeled, schemas.LABELED_BIOS)
    expected = catalog.labeled_bios(spark, SF).select(stored.columns)
    assert rows(stored) == rows(expected) != []
    jobs.export_validation_sets(spark, labeled, ages, genders, single_file=True)
    assert len(list((tmp_path / "ages").glob("part-*"))) == 1
    columns = ["user_id", "age_group", "age_label", "age_pattern"]
    assert rows(readers.read_table(spark, ages, schemas.VALIDATION_AGE)) == rows(catalog.age_groups(spark, SF), *columns)


def test_followee_job_and_its_gap_report(spark, posts_root, tmp_path):
    sink, followees = str(tmp_path / "sink"), td.followee_uids(spark, SF)

    def run(last):
        return jobs.embed_followee_posts(
            spark, posts_root, followees, sink, "2024-01-01", last, encoding.hash_encoder(), n_partitions=4
        )

    assert len(run("2024-01-02")) == 2
    gaps = jobs.missing_work(spark, sink, "2024-01-01", "2024-01-04")
    assert gaps.filter("ds > '2024-01-02'").count() == 2 * 40
    run("2024-01-30")
    run("2024-01-30")
    flat = readers.flat_posts(td.stream_posts(spark, SF), "text", "ds")
    expected = hash_embed(joins.posts_of_followees(flat, followees), "text").drop("text")
    got = snapshots.read(spark, sink).withColumn("ds", F.col("ds").cast("string"))

    def plain(df):
        return rows(df.withColumn("embed", F.transform("embed", lambda v: F.round(v, 9))).select(sorted(df.columns)))

    assert plain(got) == plain(expected)


def test_panel_job_replaces_its_half_month(spark, tmp_path):
    root, sink, panel = str(tmp_path / "posts"), str(tmp_path / "sink"), td.panel_uids(spark, SF)
    posts = td.panel_posts(spark, SF)
    writers.write_json(posts, root, partition_by=("created_at_bucket", "user_id_bucket"), compression=None)
    for half in ("2024-01-01", "2024-01-16", "2024-01-16"):
        jobs.embed_panel_posts(spark, root, panel, sink, half, encoding.hash_encoder(4), n_partitions=3)
    expected = joins.posts_of_panel(readers.flat_posts(posts, "full_text", "user_id_bucket"), panel)
    assert rows(snapshots.read(spark, sink), "id", "user_id", "full_text", "user_id_bucket") == rows(expected)


def test_files_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1\t5\tx y\n2\t6\t\n")
    (tmp_path / "in" / "b.json").write_text('{"id":3,"user_id":7,"text":"x"}\n')
    jobs.embed_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), encoding.hash_encoder(4))
    got = {r.id: (r.user_id, sum(r.embed) > 0) for r in readers.read_vectors(spark, str(tmp_path / "out")).collect()}
    assert got == {1: (5, True), 2: (6, False), 3: (7, True)}


def test_evaluation_job(spark, tmp_path):
    profiles, predictions, panel, annotations = (str(tmp_path / n) for n in ("u", "p", "s", "a"))
    writers.export_table(td.user_profiles(spark, SF), profiles, compression=None)
    jobs.predict_profiles(spark, profiles, predictions, catalog.toy_model(), batch_rows=500)
    writers.export_table(td.panel_sample(spark, SF), panel, sep=",", compression=None)
    writers.export_table(td.annotations(spark, SF), annotations, compression=None)
    today, then = F.lit("2021-06-30").cast("date"), F.lit("2018-08-01").cast("date")
    got = {r.people: r for r in jobs.evaluate_panel(spark, panel, annotations, predictions, today, then).collect()}
    decoded = evaluation.decode_predictions(catalog._predicted(spark, SF))
    truth = evaluation.with_real_age(td.panel_sample(spark, SF), today)
    everyone = evaluation.score_panel(truth, "user_id", "sex", "real_age", decoded).first()
    agreed = evaluation.score_agreed(td.annotations(spark, SF), truth, decoded, then).first()
    assert tuple(got["all"])[1:] == tuple(everyone)
    assert tuple(got["agreed"])[1:] == (agreed.agreed_rows, None, agreed.age_accuracy)


def test_collection_jobs(spark, tmp_path):
    jobs.collect_follow_responses(td.follow_responses(spark, SF), str(tmp_path / "f"))
    assert {p.name for p in (tmp_path / "f").glob("outcome=*")} == {
        "outcome=data", "outcome=empty", "outcome=error", "outcome=unknown",
    }
    edges = spark.read.schema("user_id BIGINT, followee_id BIGINT").json(str(tmp_path / "f" / "outcome=data"))
    assert rows(edges) == rows(catalog.follow_edges(spark, SF))
    jobs.collect_user_responses(td.user_responses(spark, SF), str(tmp_path / "u"), str(tmp_path / "e"))
    users = spark.read.schema("id STRING").json(str(tmp_path / "u"))
    assert rows(users) == rows(catalog.api_users(spark, SF), "id")
    assert spark.read.text(str(tmp_path / "e")).count() == catalog.api_errors_all(spark, SF).count()
