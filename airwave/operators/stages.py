"""Stages of an analysis that external models can take over.

A stage is asked for by name. Whether its model can serve is found out where it will run: a task opens it, gives it one
empty document and looks at the columns that come back. If that fails, the rules serve and the note says why. A model is
opened once in a worker process, whatever the number of tasks there, and sees batches of a bounded number of documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: what serves where nothing else is asked for, and what each stage gives of a document
RULES = {"tokenizer": "words-2", "topic": "gazetteer-1", "sentiment": "lexicon-1", "keywords": "tfidf-1", "summary": "extractive-1", "entities": "rules-1"}
OUTPUTS = {
    "topic": "topic int, topic_confidence double",
    "sentiment": "sentiment string, sentiment_confidence double",
    "keywords": "keywords array<struct<word:string,score:double>>",
    "summary": "summary string",
    "entities": "entities array<struct<text:string,label:string>>",
}
#: what a model is given
INPUT = ["_row", "title", "body", "text"]


@dataclass(frozen=True)
class Stage:
    """A model for one stage: ``open`` loads it and gives a function from a pandas frame (_row, title, body, text) to one
    with _row and the stage's outputs, a row for each row."""

    kind: str
    name: str
    open: Callable[[], Callable]
    batch: int = 16


@dataclass(frozen=True)
class Choice:
    kind: str
    requested: str
    active: str
    note: str | None = None
    stage: Stage | None = None


_warm: dict[tuple[str, str], Callable] = {}


def _model(stage: Stage) -> Callable:
    """The worker's own instance."""
    key = (stage.kind, stage.name)
    if key not in _warm:
        _warm[key] = stage.open()
    return _warm[key]


def _columns(kind: str) -> list[str]:
    return ["_row", *(c.split(" ")[0] for c in OUTPUTS[kind].split(", "))]


def _asked(stage: Stage, frame):
    """The model's answer for a frame, with the columns and rows that it has to have."""
    out, columns = _model(stage)(frame), _columns(stage.kind)
    missing = [c for c in columns if c not in out.columns]
    if missing:
        raise ValueError(f"{stage.name} gives no {', '.join(missing)}")
    if sorted(out["_row"]) != sorted(frame["_row"]):
        raise ValueError(f"{stage.name} does not give a row for each document")
    return out[columns]


def _probe(spark: SparkSession, stage: Stage) -> str | None:
    def run(frames):
        import pandas as pd

        for frame in frames:
            try:
                _asked(stage, frame)
                note = None
            except Exception as e:  # noqa: BLE001  whatever keeps a model from serving is what the note says
                note = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"note": [note]})

    return spark.createDataFrame([(0, "", "", "")], "_row long, title string, body string, text string").mapInPandas(run, "note string").first()["note"]


def choose(spark: SparkSession, requested: dict[str, str] | None = None, known: list[Stage] = ()) -> dict[str, Choice]:
    """What serves each stage, given what is ``requested`` (stage -> name) and the ``known`` models."""
    requested = requested or {}
    if wrong := [k for k in requested if k not in RULES]:
        raise ValueError(f"no such stage: {', '.join(wrong)}")
    out = {}
    for kind, rules in RULES.items():
        asked = requested.get(kind, rules)
        stage = next((s for s in known if (s.kind, s.name) == (kind, asked) and kind in OUTPUTS), None)
        if asked == rules:
            out[kind] = Choice(kind, asked, rules)
        elif stage is None:
            out[kind] = Choice(kind, asked, rules, f"{asked} is not known, {rules} serves")
        elif note := _probe(spark, stage):
            out[kind] = Choice(kind, asked, rules, f"{note}; {rules} serves")
        else:
            out[kind] = Choice(kind, asked, asked, None, stage)
    return out


def run(rows: DataFrame, stage: Stage) -> DataFrame:
    """(_row and the stage's outputs) of rows (_row, title, body, text), in batches of the stage's size."""

    def each(frames):
        for frame in frames:
            for at in range(0, len(frame), stage.batch):
                yield _asked(stage, frame.iloc[at : at + stage.batch])

    return rows.select(*INPUT).mapInPandas(each, f"_row long, {OUTPUTS[stage.kind]}")


def status(analysed: DataFrame, choices: dict[str, Choice]) -> DataFrame:
    """(stage, requested, active, trained, note, documents): what served each stage of documents with model_versions, and
    how many it served."""
    spark = analysed.sparkSession
    said = [(c.kind, c.requested, c.active, c.stage is not None, c.note) for c in choices.values()]
    frame = spark.createDataFrame(said, "stage string, requested string, active string, trained boolean, note string")
    served = analysed.select(F.explode("model_versions").alias("stage", "active")).groupBy("stage", "active").agg(F.count("*").alias("documents"))
    return frame.join(served, ["stage", "active"], "left").select("stage", "requested", "active", "trained", "note", F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"))
