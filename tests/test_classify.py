from itertools import product

from pyspark.sql import functions as F

from logtrail.functions.messages import APPLICATION_NAMES
from logtrail.operators.normalize import normalize_csv
from logtrail.plans.classify import SOURCE_LABELS, TextModels, _bounded, _shares, predict, train, train_models

# Labelled texts made from a few templates and fillers.
SOURCES = {
    "nginx_access": "{ip} GET /{word} HTTP/2 status 200 upstream {word}",
    "linux_auth": "sshd pam session for {word} from {ip} publickey",
    "db_mysql": "mysqld slow query table {word} lock wait {ip}",
}
THREATS = {
    "benign": "GET /{word}/list page {ip}",
    "sql_injection": "GET /{word}?id=7 UNION ALL SELECT password FROM {word} -- {ip}",
    "xss": "POST /{word} comment <script>document.location={ip}</script> {word}",
}
FILLERS = tuple(product(("10.0.0.1", "10.2.3.4", "192.0.2.9"), ("shop", "report", "invoice", "photo")))


def corpus(spark, templates):
    rows = [(t.format(ip=ip, word=word), label) for label, t in templates.items() for ip, word in FILLERS]
    return spark.createDataFrame(rows, "text string, label string")


def test_models_label_their_corpus_and_drive_events(spark, tmp_path):
    sources, threats = corpus(spark, SOURCES), corpus(spark, THREATS)
    models = train_models(sources, threats)
    models.save(str(tmp_path / "models"))
    models = TextModels.load(str(tmp_path / "models"))
    for texts, column in ((sources, "source_label"), (threats, "threat_type")):
        assert models.label(texts, "text").filter(F.col(column) != F.col("label")).isEmpty()
    row = spark.createDataFrame(
        [("GET /photo?id=9 UNION ALL SELECT password FROM photo -- 10.9.9.9", "w.csv", 0, 0)],
        "message string, source_file string, file_seq int, row_no long",
    )
    event = normalize_csv(row, models=models).first()
    assert (event.threat_type, event.severity) == ("sql_injection", "critical")
    assert event.source in SOURCE_LABELS and event.process == APPLICATION_NAMES[event.source]
    assert event.details.endswith("AI THREAT: SQL_INJECTION")


def test_fit_is_bounded_by_rows_and_not_by_terms(spark):
    terms = train(corpus(spark, SOURCES)).stages[4].vocabulary
    assert len(train(corpus(spark, SOURCES), most_rows=6).stages[4].vocabulary) < len(terms)


def test_bounded_fit_keeps_every_label_and_repeated_lines(spark):
    hot = [("cron session opened for root", "cron")] * 600 + [("kernel link is up", "kernel")] * 300
    rows = hot + [(f"request {k} page p{k}", "web") for k in range(200)] + [(f"query {k} table t{k}", "db") for k in range(150)]
    df = spark.createDataFrame(rows, "text string, label string").repartition(5)
    taken = [(r[0], r[1], r[2]) for r in _bounded(df.toDF("_lt_text", "_lt_label"), 40).collect()]
    assert len(taken) == 40 and {label for _, label, _ in taken} == {"cron", "kernel", "web", "db"}
    assert {n for _, label, n in taken if label == "cron"} == {600.0} and len({t for t, _, _ in taken}) == 40
    model = train(df, most_rows=40)
    assert model.stages[-1].getLabels() == ["cron", "db", "kernel", "web"]
    assert predict(df, model, "text", "got").filter("got <> label").isEmpty()
    assert _shares([("a", 1), ("b", 1), ("c", 9)], 2) == [("a", 1, 1), ("b", 1, 1), ("c", 9, 1)]


def test_without_models(spark):
    df = spark.createDataFrame([("x",)], "message string")
    row = TextModels().label(df, "message").first()
    assert (row.source_label, row.threat_type) == ("unknown", "benign")
