"""python -m weftline COMMAND …

run QUERY TABLES [OUT]            a registered query; Parquet to OUT, or the first rows
prepare RAW PROCESSED RECORD SETTINGS MODE    data preparation in stages (train, resume or evaluate)
fit-merges | fit-lattice TEXTS FOLDER PIECES  a vocabulary from the `text` column of Parquet files
balance TEXTS FOLDER              documents, bytes and tokens of each `language` under a vocabulary of merges
analyze RESULTS BASELINE PROPOSED SEED…       the paired report of a tree of results, as Markdown
record FILE NAME=PATH…            which artifacts of an experiment there are, with their contents
"""

from __future__ import annotations

import sys
from collections.abc import Callable


def _spark(name: str):  # noqa: ANN202
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(f"weftline {name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run(name: str, tables: str, out: str | None = None) -> None:
    from .plans.contract import QUERIES

    if name not in QUERIES:
        raise ValueError(f"queries: {' '.join(sorted(QUERIES))}")
    rows = QUERIES[name](_spark(name), tables)
    rows.write.mode("errorifexists").parquet(out) if out else rows.show(20, truncate=60)


def prepare(raw: str, processed: str, record: str, settings: str, mode: str) -> None:
    from .plans import stages

    box = stages.Preparation(_spark("prepare"), raw, processed, record, stages.load_settings(settings, ("languages", "splits", "filtering", "tolerance")))
    print(sorted(box.run(mode, tasks="downstream" in box.settings)["plans"]))


def _fit(lattice: bool) -> Callable[[str, str, str], None]:
    def fit(texts: str, folder: str, pieces: str) -> None:
        from .operators import subword
        from .plans.provenance import config_identity
        from .sources import vocabulary

        spark = _spark("fit")
        rows = spark.read.parquet(texts).select("text")
        settings = {"texts": texts, "pieces": int(pieces)}
        if lattice:
            made: subword.Merges | subword.Lattice = subword.fit_lattice(subword.word_counts(rows), int(pieces))
        else:
            made = subword.fit_merges_apart(subword.part_counts(rows), int(pieces))
        print(vocabulary.save(spark, folder, made, config_identity(settings), settings))

    return fit


def balance(texts: str, folder: str) -> None:
    from .operators import subword
    from .plans.contract import token_balance
    from .sources import vocabulary

    spark = _spark("balance")
    token_balance(subword.merge_token_counts(spark.read.parquet(texts), vocabulary.load(spark, folder, kind="bpe"), ["language"])).show(truncate=False)


def analyze(results: str, baseline: str, proposed: str, *seeds: str) -> None:
    from .operators.stats import markdown
    from .plans import analysis

    report, _ = analysis.analyze(analysis.results(_spark("analyze"), results), [int(s) for s in seeds], baseline, proposed)
    print(markdown(report, ["repository", "metric"]))


def record(file: str, *named: str) -> None:
    from .plans import provenance

    provenance.write_json(file, provenance.experiment_record(dict(n.split("=", 1) for n in named)))


COMMANDS: dict[str, Callable[..., None]] = {"run": run, "prepare": prepare, "fit-merges": _fit(False), "fit-lattice": _fit(True), "balance": balance, "analyze": analyze, "record": record}


def main(args: list[str]) -> int:
    if not args or args[0] not in COMMANDS:
        print(__doc__)
        return 2
    try:
        COMMANDS[args[0]](*args[1:])
    except (TypeError, ValueError) as error:
        print(error)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
