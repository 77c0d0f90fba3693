"""python -m glosswright: single subjects and files on a local session.  Prints JSON lines; exit 1 when a check fails."""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import platform
import sys

VERSION = "0.2.0"


def capabilities() -> dict:
    """What this installation can do.  Nothing is ever fetched from a network."""
    optional = {m: importlib.util.find_spec(m) is not None for m in ("pyarrow", "pandas", "numpy", "regex", "duckdb")}
    return {"version": VERSION, "python": platform.python_version(), "modules": optional, "languages": ["en", "fr", "de", "es"], "taggers": ["heuristic"], "network": False}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glosswright", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("version", "doctor"):
        sub.add_parser(name)
    for name in ("tokens", "sentences", "extract"):
        sub.add_parser(name).add_argument("text")
    for name in ("generate", "score", "backronym"):
        c = sub.add_parser(name)
        c.add_argument("phrase")
        if name != "generate":
            c.add_argument("target")
        c.add_argument("--preset", default="strict_initialism")
        c.add_argument("--lexicon", help="a file of words, one a line")
        c.add_argument("--limit", type=int, default=10)
    c = sub.add_parser("synthesize")
    c.add_argument("target")
    c.add_argument("--lexicon", required=True)
    c.add_argument("--limit", type=int, default=5)
    for name in ("expand-token", "expand-identifier", "physical-name", "normalize-name", "check-name", "governed-batch", "governed-audit"):
        c = sub.add_parser(name)
        c.add_argument("subject", help="a name, or a path for governed-batch and governed-audit")
        c.add_argument("--bundle", required=True, help="a folder or JSON object")
        c.add_argument("--policy", default="governed_default")
        if name == "governed-batch":
            c.add_argument("--op", default="expand")
        if name == "governed-audit":
            c.add_argument("--limit", type=int, default=20)
    return p


def _show(rows) -> None:
    for r in rows.toJSON().collect():  # of one subject
        print(r)


def _words(spark, path):
    from .operators.vocabulary import literal
    from .sources.readers import lexicon_text

    return lexicon_text(spark, path) if path else literal(spark, [], "word string")


def _text_command(spark, args) -> int:
    from pyspark.sql import functions as F

    from .functions import phonetics as ph
    from .functions.sentences import sentences
    from .operators import backronym, extract, generate, tokenize
    from .operators.vocabulary import literal

    if args.command in ("tokens", "sentences", "extract"):
        rows = literal(spark, [(1, args.text)], "doc_id long, text string")
        if args.command == "tokens":
            _show(tokenize.token_rows(tokenize.tokenize(rows, id_column="doc_id")).drop("id"))
        else:
            _show((sentences(rows) if args.command == "sentences" else extract.extract_definitions(rows)).drop("doc_id"))
        return 0
    words = _words(spark, args.lexicon)
    if args.command == "synthesize":
        targets = literal(spark, [("1", args.target)], "id string, target string")
        found = generate.synthesize(targets, words, args.limit)
        _show(backronym.score_synthesized(found, targets, generate.PRESETS["strict_initialism"], ph.fit_bigrams(words), words).drop("id").orderBy("rank"))
        return 0
    weights, model = generate.PRESETS[args.preset], ph.fit_bigrams(words) if args.lexicon else ph.uniform_model()
    tokens = tokenize.tokenize(literal(spark, [(1, args.phrase)], "id long, text string"))
    if args.command == "generate":
        row = generate.generate(tokens, weights, model, words, generate.Search(limit=args.limit)).first()
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False))
        return 0 if row["ok"] else 1
    kept = F.filter("tokens", lambda t: t["eligible"])
    phrase = tokens.select("id", F.lit(args.target).alias("target"), F.transform(kept, lambda t: t["text"]).alias("words"), F.transform(kept, lambda t: t["critical"]).alias("critical"))
    if args.command == "score":
        _show(backronym.score_given(phrase, weights, model, words).drop("id"))
    else:
        _show(backronym.score_aligned(backronym.align_phrases(phrase, args.limit, weights), weights, model, words).drop("id").orderBy("rank"))
    return 0


def _governed_command(spark, args) -> int:
    from pyspark.sql import functions as F

    from .operators import governed
    from .operators.vocabulary import POLICIES, literal
    from .session import work_folder
    from .sources.bundles import load_bundle
    from .sources.results import render_audit
    from .streaming import lines

    vocab, policy = load_bundle(spark, args.bundle), POLICIES[args.policy]
    if args.command == "governed-audit":
        ids = spark.read.text(args.subject).where(F.trim("value") != "").select(F.xxhash64("value").alias("id"), F.trim("value").alias("identifier"))
        print(render_audit(governed.Audit(ids, vocab, policy), args.limit))
        return 0
    if args.command == "governed-batch":
        out = work_folder(spark, "batch")
        lines.run(lines.read_lines(spark, args.subject), out, f"{out}-checkpoint", vocab, policy, args.op).awaitTermination()
        rows = spark.read.schema("line long, id string, input string, ok boolean, result string, error string, error_type string").json(out)
        failed = 0
        for r in lines.record(rows.orderBy("line")).toLocalIterator():
            print(r["value"])
            failed |= '"ok":false' in r["value"]
        return int(failed)
    ids = literal(spark, [(1, args.subject)], "id long, identifier string")
    if args.command == "expand-token":
        _show(governed.expand_tokens(ids.select("id", F.col("identifier").alias("token")), vocab, policy).drop("id", "keep", "canonical"))
    elif args.command == "expand-identifier":
        _show(governed.expand_identifiers(ids, vocab, policy).drop("id"))
    elif args.command == "physical-name":
        _show(governed.to_physical(ids.withColumnRenamed("identifier", "logical"), vocab, policy).drop("id"))
    elif args.command == "normalize-name":
        _show(governed.normalize(ids, vocab, policy).drop("id"))
    else:
        rows = governed.compliance_findings(ids, vocab, policy).drop("id").orderBy("seq")
        _show(rows)
        return int(rows.where("verdict = 'fail'").count() > 0)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command in ("version", "doctor"):
        print(VERSION if args.command == "version" else json.dumps(capabilities()))
        return 0
    from .session import session, ship

    spark = session(os.environ.get("GLOSSWRIGHT_CORES", "2"), memory="2g", **{"spark.sql.shuffle.partitions": "2", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return _governed_command(spark, args) if hasattr(args, "bundle") else _text_command(spark, args)


if __name__ == "__main__":
    sys.exit(main())
