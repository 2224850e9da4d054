import argparse
import json

import pytest
from pyspark.sql import functions as F

from paralens import cli, report, schemas, tasks
from paralens.operators import accounting, pool
from paralens.plans.analysis import analyse
from paralens.sources import clients, responses, sinks
from paralens.streaming.accounting import log_stream, running_accounts


def replies(wordings, items):
    """Right answers, but the second wording always fails on the first item and the third is always wrong."""
    out = {}
    for p, w in wordings:
        for k, x in enumerate(items):
            if not (p == 1 and k == 0):
                out[w.format(**x.slots)] = "0" if p == 2 else f"It is {x.answer}."
    return out


@pytest.fixture(scope="module")
def study(spark):
    task = tasks.get("mult")
    wordings = [(p, f"Wording {p}: multiply {{a}} by {{b}}, please.") for p in range(4)]
    pool_ = spark.createDataFrame(wordings, "id long, text string")
    work = pool.work_list(pool_, tasks.items(spark, task), spark.createDataFrame([], schemas.RESPONSE))
    answers = replies(wordings, task.items)
    done = clients.collected(work, lambda: clients.Replay(answers), workers=3, retries=1, pause=0).cache()
    return task, pool_, done


def test_collects_every_call(study):
    task, _, done = study
    assert done.count() == 4 * 24 and done.schema == schemas.RESPONSE
    failed = done.where("r IS NULL").collect()
    assert [(r.p, r.i) for r in failed] == [(1, task.items[0].key)] and "KeyError" in failed[0].e


def test_log_resumes(spark, study, tmp_path):
    task, pool_, done = study
    sinks.append_log(done.limit(50).withColumn("task", F.lit("mult")).withColumn("model_slug", F.lit("m")), str(tmp_path / "log"))
    back = sinks.read_appended(spark, str(tmp_path / "log"), schemas.RESPONSE)
    assert back.count() == 50
    assert pool.work_list(pool_, tasks.items(spark, task), back).count() == 4 * 24 - 50


def test_reads_named_logs_with_blank_lines(spark, tmp_path):
    line = lambda p: json.dumps({"p": p, "i": "x", "r": None, "n": None, "ms": 5, "e": "t"})
    (tmp_path / "mult__a-b__000.jsonl").write_text(line(1) + "\n\n" + line(1) + "\n")
    (tmp_path / "mult__a-b__001.jsonl").write_text(line(2) + "\n")
    (tmp_path / "mult__other__000.jsonl").write_text(line(3) + "\n")
    log = responses.read_log(spark, str(tmp_path), "mult", "a:b")
    assert sorted(r.p for r in log.collect()) == [1, 1, 2] and responses.done_keys(log).count() == 2
    assert responses.read_log(spark, str(tmp_path), "mult", "none").count() == 0
    metas = spark.createDataFrame([("mult", "a:b")], "task string, model string")
    assert [tuple(r) for r in responses.runs(responses.file_names(spark, str(tmp_path)), metas).collect()] == [("mult", "a:b", "a-b"), ("mult", "other", "other")]
    assert responses.read_equivalent_ids(spark, str(tmp_path / "none.json")) is None


def test_analysis_and_page(spark, study):
    task, pool_, done = study
    found = analyse(done.select("p", "i", "r"), tasks.items(spark, task), pool_, "integer", 24, permutations=20, splits=10, reps=20)
    doc = found.document()
    assert doc["paraphrases_dropped_for_failed_calls"] == 1 and doc["strict"]["n"] == 3 and doc["accounting"]["wrong"] == 24
    assert doc["best_and_worst"]["best"] == 0 and doc["best_and_worst"]["worst"] == 2 and doc["canonical"]["canonical_accuracy"] == 1.0
    assert sum(b["n"] for b in doc["histogram"]) == 3 and len(doc["features"]) == 14
    runs = [{"task": "mult", "model": "<m>", **doc}]
    assert report.page(runs) == report.page(runs) and "&lt;m&gt;" in report.page(runs) and "script" not in report.page(runs)
    only = spark.createDataFrame([(0,), (3,)], "p long")
    some = analyse(done.select("p", "i", "r"), tasks.items(spark, task), pool_, "integer", 24, only, 5, 5, 5)
    assert some.strict.first().n == 2 and some.unfiltered.first().n == 3 and some.spread.first().cochran_q is None


def test_running_accounts(spark, study, tmp_path):
    task, _, done = study
    done.drop("e").unionByName(done.drop("e")).withColumn("e", F.lit(None).cast("string")).write.json(str(tmp_path / "in"))
    counts = running_accounts(log_stream(spark, str(tmp_path / "in")), tasks.items(spark, task), "integer")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("accounts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    rows = {r.p: r for r in spark.table("accounts").collect()}
    assert rows[0].attempts == 24 and rows[0].correct == 24 and rows[1].error == 1 and rows[2].wrong == 24


def test_patience():
    class Flaky:
        calls = 0

        def ask(self, prompt):
            self.calls += 1
            if self.calls < 3:
                raise OSError("busy")
            return "yes", 1

    waits = []
    assert clients.ask_patiently(Flaky(), "x", 3, 1.5, waits.append) == ("yes", 1, None) and waits == [1.5, 3.0]
    assert clients.ask_patiently(Flaky(), "x", 2, 0, waits.append)[0] is None


def test_round_trips(spark):
    class Translator:
        def ask(self, prompt):
            head, _, rest = prompt.partition("\n")
            if "w2" in prompt:
                raise OSError("down")
            if "Spanish" in head:
                return f" es({rest}) ", 1
            if "English" in head:
                return rest[3:-1].replace("{b}", "{c}" if "w1" in rest else "{b}"), 1
            return "equivalent; same", 1

    wordings = spark.createDataFrame([(k, f"w{k} multiply {{a}} by {{b}} for me") for k in range(3)], "id long, text string")
    rows = {r.id: r for r in cli.round_trips(wordings, tasks.get("mult"), Translator, 2).collect()}
    assert (rows[0].verdict, rows[0].slots_survived, rows[1].slots_survived) == ("EQUIVALENT", True, False)
    assert rows[2].spanish is None and rows[2].slots_survived is False


def test_command_line_defaults():
    args = cli.parser().parse_args(["run", "--task", "mult", "--model", "m"])
    assert args.call is cli.run and args.limit is None and args.workers == 6
    assert cli.parser().parse_args(["analyze"]).permutations == 1000


def test_last_record_of_a_call_counts(spark):
    rows = spark.createDataFrame([(1, "a", None, 1), (1, "a", "5", 2), (1, "b", "6", 1)], "p long, i string, r string, at long")
    assert {(r.p, r.i, r.r) for r in accounting.latest(rows).collect()} == {(1, "a", "5"), (1, "b", "6")}


def test_named_logs_are_in_order(spark, tmp_path):
    line = lambda r: json.dumps({"p": 1, "i": "x", "r": r, "n": 1, "ms": 5})
    (tmp_path / "mult__m__000.jsonl").write_text(line("first") + "\n" + line("second") + "\n")
    (tmp_path / "mult__m__001.jsonl").write_text("\n".join(line(f"later {k}") for k in range(9)))
    assert [r.r for r in accounting.latest(responses.read_log(spark, str(tmp_path), "mult", "m")).collect()] == ["later 8"]


def test_generator_client(monkeypatch):
    sent = {}

    class Reply:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self, *_):
            return json.dumps({"candidates": [{"content": {"parts": [{"text": "a"}, {}, {"text": "b"}]}}]})

    monkeypatch.setattr(clients.urllib.request, "urlopen", lambda request, timeout: sent.update(url=request.full_url, body=json.loads(request.data)) or Reply())
    client = clients.GeneratorClient("http://x/models", "m", key="k")
    assert client.ask("hello") == ("ab", None) and sent["url"] == "http://x/models/m:generateContent?key=k"
    assert sent["body"]["contents"][0]["parts"][0]["text"] == "hello" and [client.delay(k) for k in (1, 2, 3)] == [1.0, 2.0, 4.0]
    with pytest.raises(ValueError):
        clients.GeneratorClient("http://x", "m")


def test_commands_from_end_to_end(spark, tmp_path, monkeypatch):
    """All five commands with answers replayed; one call fails first and is right when retried."""
    task = tasks.get("mult")
    marks = str(tmp_path / "marks")

    class Model:
        def ask(self, prompt):
            import os
            import re

            a, b = map(int, re.findall(r"[0-9]+", prompt)[:2])
            if (a, b) == (79, 92) and not os.path.exists(marks):
                raise OSError("down")
            return str(a * b + ("Please" in prompt)), 3

    class Generator:
        def ask(self, prompt):
            if prompt.startswith("Rewrite"):
                return "1. Multiply {a} by {b} and say the plain integer only.\n2. Please work out {a} times {b} now, plain integer.\n3. Multiply {a}!", None
            head, _, rest = prompt.partition("\n")
            return ("DIFFERENT; no" if "Please" in rest else "EQUIVALENT; same") if "EQUIVALENT" in head else rest, None

    monkeypatch.setattr(cli, "_client", lambda args: Model)
    monkeypatch.setattr(cli, "_generator", lambda args, temperature: Generator)
    patient = clients.ask_patiently
    monkeypatch.setattr(clients, "ask_patiently", lambda client, prompt, retries, pause: patient(client, prompt, 1, 0))

    def call(*argv):
        args = cli.parser().parse_args(["--results", str(tmp_path), *argv])
        args.call(spark, args)

    call("paraphrase", "--task", "mult", "--model", "g", "--calls", "2", "--workers", "2")
    made = json.loads((tmp_path / "paraphrases_mult.json").read_text())
    assert [w["id"] for w in made["paraphrases"]] == [0, 1, 2] and made["raw_candidates"] == 6 and len(made["rejected"]) == 2 and made["duplicates_dropped"] == 2
    call("equiv", "--task", "mult", "--model", "g", "--backtranslate", "2")
    assert json.loads((tmp_path / "equivalence_mult.json").read_text())["equivalent_ids"] == [0, 1]
    call("run", "--task", "mult", "--model", "m:1", "--limit", "30")
    call("run", "--task", "mult", "--model", "m:1")
    log = cli._log(spark, argparse.Namespace(results=str(tmp_path)))
    assert log.count() == 72 and log.where("r IS NULL").count() == 3
    (tmp_path / "marks").touch()
    call("run", "--task", "mult", "--model", "m:1", "--retry-failed")
    assert cli._log(spark, argparse.Namespace(results=str(tmp_path))).count() == 75
    call("repeat", "--task", "mult", "--model", "m:1", "--sample", "10")
    told = json.loads((tmp_path / "repeat_mult__m-1.json").read_text())
    assert (told["n"], told["identical"]) == (10, 10)
    call("analyze", "--permutations", "20", "--splits", "10")
    (one,) = json.loads((tmp_path / "analysis.json").read_text())["runs"]
    assert one["model"] == "m:1" and one["unfiltered"]["n"] == 3 and one["strict"]["n"] == 2 and one["strict"]["mean"] == 1.0 and one["paraphrases_dropped_for_failed_calls"] == 0
    assert "m:1" in (tmp_path / "index.html").read_text() and task.name in (tmp_path / "index.html").read_text()
