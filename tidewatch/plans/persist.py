"""Saving and loading everything fitted, so that fitting and scoring can be two jobs.

Tables go to Parquet, the forest to its own ML folder, numbers to one JSON row. The manifest is written last: a folder
without one was not finished, and one of another schema version is refused.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators.cohorts import CohortModel
from tidewatch.operators.corpus import Corpus
from tidewatch.operators.features import Knowledge
from tidewatch.operators.risk import RiskModel
from tidewatch.operators.tiers import Bottleneck, Classifier, Normaliser
from tidewatch.plans.fit import State
from tidewatch.sources.tables import load_state, save_state


def _tables(state: State) -> dict[str, DataFrame]:
    know = state.knowledge
    found = {
        "corpus": know.corpus.counts if know.corpus else None, "profiles": know.profiles, "priors": know.priors,
        "codes": state.codes, "vocab": state.vocab, "transitions": state.transitions,
    }
    return {name: df for name, df in found.items() if df is not None}


def save_fitted(spark: SparkSession, state: State, path: str) -> None:
    know, forest = state.knowledge, state.classifier
    numbers = {
        "vocab_size": state.vocab_size,
        "scaler": {n: list(v) for n, v in state.scaler.items()},
        "corpus": {k: v for k, v in vars(know.corpus).items() if k != "counts"} if know.corpus else None,
        "cohorts": asdict(know.cohorts) if know.cohorts else None,
        "components": [list(r) for r in state.bottleneck.components] if state.bottleneck else None,
        "baseline_norm": asdict(state.bottleneck.normaliser) if state.bottleneck else None,
        "sequence_norm": asdict(state.sequence_norm) if state.sequence_norm else None,
        "classes": {"names": forest.classes, "knots": forest.knots, "inputs": forest.inputs} if forest else None,
        "risk": asdict(state.risk),
    }
    if forest:
        forest.model.write().overwrite().save(f"{path}/forest")
    told = spark.createDataFrame([(json.dumps(numbers),)], "numbers string")
    save_state(spark, {**_tables(state), "numbers": told}, path)


def _pairs(knots) -> tuple:
    return tuple((float(a), float(b)) for a, b in knots)


def load_fitted(spark: SparkSession, path: str) -> State:
    """The state that save_fitted() wrote; raises where the manifest is missing or of another version."""
    tables = load_state(spark, path)
    x = json.loads(tables["numbers"].first().numbers)
    cohorts = x["cohorts"]
    if cohorts:
        cohorts["sizes"] = {int(k): v for k, v in cohorts["sizes"].items()}
    scaler = {n: tuple(v) for n, v in x["scaler"].items()}
    know = Knowledge(
        corpus=Corpus(counts=tables["corpus"], **x["corpus"]) if x["corpus"] else None,
        profiles=tables.get("profiles"), priors=tables.get("priors"), cohorts=CohortModel(**cohorts) if cohorts else None,
    )
    classifier = None
    if x["classes"]:
        from pyspark.ml.classification import RandomForestClassificationModel

        c = x["classes"]
        classifier = Classifier(RandomForestClassificationModel.load(f"{path}/forest"), c["names"], {n: _pairs(k) for n, k in c["knots"].items()}, c["inputs"])
    risk = x["risk"]
    return State(
        know, tables["codes"], tables["vocab"], x["vocab_size"], scaler,
        bottleneck=Bottleneck(scaler, x["components"], Normaliser(**x["baseline_norm"])) if x["components"] else None,
        transitions=tables.get("transitions"), sequence_norm=Normaliser(**x["sequence_norm"]) if x["sequence_norm"] else None,
        classifier=classifier, risk=RiskModel(**(risk | {"weights": tuple(risk["weights"]), "knots": _pairs(risk["knots"])})),
    )
