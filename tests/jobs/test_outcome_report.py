"""The report job against plain ranks, and reruns over changed input."""

import random
import subprocess
import sys

import numpy as np
import pytest

from jobs import outcome_report
from jobs.common import settings

CONFIG = settings("outcome_report")


def docs(rng, n):
    words = ["alpha", "Beta.", "g4mma", "d", "Élan", "漢字", "10%", "end!"]
    return [
        (i, None if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", "007", None, "one class"]))
        for i in range(n)
    ]


def write(spark, path, records, labels):
    spark.createDataFrame(records, "doc_id long, text string, lang string").write.mode("overwrite").parquet(f"{path}/docs")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.mode("overwrite").parquet(f"{path}/labels")


def run(spark, path):
    return outcome_report.run(spark, f"{path}/docs", f"{path}/labels", f"{path}/out", CONFIG)


def measures(text):
    found = [w for w in text.replace("\n", " ").split(" ") if w]
    return {
        "n_chars": len(text),
        "n_words": len(found),
        "mean_word_length": sum(map(len, found)) / len(found),
        "digit_pct": 100 * sum(c in "0123456789" for c in text) / len(text),
        "capital_pct": 100 * sum("A" <= c <= "Z" for c in text) / len(text),
        "stops_per_100_words": 100 * sum(c in ".!?" for c in text) / len(found),
        "distinct_pct": 100 * len(set(found)) / len(found),
    }


def test_equal_to_plain_ranks(spark, tmp_path):
    rng = random.Random(1)
    records = docs(rng, 400)
    labels = [(i, rng.choice([0, 0, 1, None]) if lang != "one class" else 0) for i, _, lang in records if rng.random() < 0.8]
    write(spark, tmp_path, records, labels)
    done = run(spark, tmp_path)
    assert done["records"] == 400 and done["outcomes"] == len(labels) and done["labelled"] == sum(y is not None for _, y in labels)
    got = {(r["group"], r["measure"]): r for r in outcome_report.result(spark, f"{tmp_path}/out").collect()}
    known, want, excluded = dict(labels), {}, {}
    for i, text, lang in records:
        if known.get(i) is None:
            continue
        group = lang or ""
        if text is None or len(text.split()) < 5:
            excluded[group] = excluded.get(group, 0) + 1
            continue
        for name, v in measures(text).items():
            want.setdefault((group, name), ([], []))[known[i]].append(v)
    assert got.keys() == want.keys() and done["written"] == len(want)
    tests = sum(bool(a and b) for a, b in want.values())
    for k, (zero, one) in want.items():
        r = got[k]
        assert (r["n_0"], r["n_1"], r["n_excluded"]) == (len(zero), len(one), excluded.get(k[0], 0))
        for c, values in (("0", zero), ("1", one)):
            for name, q in (("p25", 25), ("median", 50), ("p75", 75)):
                assert r[f"{name}_{c}"] == (pytest.approx(np.percentile(values, q)) if values else None)
        if not one:
            assert r["auroc"] is None and r["z"] is None and r["p_value"] is None and r["p_value_bonferroni"] is None
            continue
        u = sum((a > b) + 0.5 * (a == b) for a in one for b in zero)
        assert r["u_statistic"] == pytest.approx(u) and r["auroc"] == pytest.approx(u / len(one) / len(zero))
        assert r["p_value_bonferroni"] == pytest.approx(min(1, r["p_value"] * tests))


def test_reruns_and_changed_groups(spark, tmp_path):
    rng = random.Random(2)
    records = docs(rng, 150)
    labels = [(i, rng.randrange(2)) for i, *_ in records]
    write(spark, tmp_path, records, labels)
    run(spark, tmp_path)
    first = sorted(map(str, outcome_report.result(spark, f"{tmp_path}/out").collect()))
    run(spark, tmp_path)
    assert sorted(map(str, outcome_report.result(spark, f"{tmp_path}/out").collect())) == first
    # New outcomes of one group take the place of its rows; all groups of the input are written.
    write(spark, tmp_path, records, [(i, 1 - y if records[i][2] == "en" else y) for i, y in labels])
    run(spark, tmp_path)
    again = sorted(map(str, outcome_report.result(spark, f"{tmp_path}/out").collect()))
    assert len(again) == len(first) and again != first


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert run(spark, tmp_path)["written"] == 0


def test_command_line(spark, tmp_path):
    rng = random.Random(3)
    records = docs(rng, 60)
    write(spark, tmp_path, records, [(i, i % 2) for i, *_ in records])
    arguments = [
        "--records", f"{tmp_path}/docs", "--outcomes", f"{tmp_path}/labels", "--output", f"{tmp_path}/out", "--config",
        str(tmp_path / "c.json")
    ]
    (tmp_path / "c.json").write_text('{"floor": 1}')
    done = subprocess.run([sys.executable, "-m", "jobs.outcome_report", *arguments], capture_output=True, text=True, timeout=300)
    # Without a shared folder a session in one process takes a local one.
    assert done.returncode == 0, done.stderr[-2000:]
    assert outcome_report.result(spark, f"{tmp_path}/out").count() > 0
