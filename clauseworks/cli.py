"""Commands: index a folder, search it, evaluate, serve."""

from __future__ import annotations

import argparse
import os
import sys

from pathlib import Path

from .functions.embedding import MODELS, HashEmbedder, LoadedEmbedder
from .functions.text import wrap
from .operators.chunking import ChunkConfig, word_tokens
from .session import local_session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clauseworks", description=__doc__)
    p.add_argument("--index-dir", default=os.environ.get("CLAUSEWORKS_INDEX", "clauseworks-index"))
    p.add_argument("--model", default=os.environ.get("CLAUSEWORKS_MODEL", ""), help="a registered model; without one, hashed words stand in")
    p.add_argument("--model-dir", default=os.environ.get("CLAUSEWORKS_MODEL_DIR", "models"))
    p.add_argument("--max-tokens", type=int, default=200)
    p.add_argument("--overlap", type=int, default=40)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index")
    c.add_argument("folder")
    c.add_argument("--dry-run", action="store_true")
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("-k", type=int, default=10)
    c = sub.add_parser("eval")
    c.add_argument("queries")
    c.add_argument("spans")
    c.add_argument("out")
    c.add_argument("--timing", action="store_true")
    c.add_argument("--source", help="folder of documents: indexed first, unless the index was built from it with these settings")
    c = sub.add_parser("serve")
    c.add_argument("--port", type=int, default=8400)
    return p


def embedder_of(name: str, folder: str) -> HashEmbedder | LoadedEmbedder:
    if not name:
        return HashEmbedder()
    if name not in MODELS:
        raise SystemExit(f"unknown model {name}; known: {', '.join(MODELS)}")
    return LoadedEmbedder(MODELS[name], str(Path(folder, MODELS[name].directory)))


def causes(error: BaseException) -> str:
    """The messages of an error and of what caused it; one that a message before already holds is left out."""
    said: list[str] = []
    at: BaseException | None = error
    while at is not None:
        message = str(at) or type(at).__name__
        if not any(message in x for x in said):
            said.append(message)
        at = at.__cause__
    return ": ".join(said)


def main(args: list[str] | None = None) -> int:
    from .plans import effectiveness, index
    from .sources.files import read_files, walk

    a = _parser().parse_args(args)
    try:
        config = ChunkConfig(a.max_tokens, a.overlap)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    embedder = embedder_of(a.model, a.model_dir)
    try:
        if a.command == "index" and not a.dry_run:
            index.check_places(Path(a.folder), Path(a.index_dir))
        spark = local_session()
        if a.command == "index" and a.dry_run:
            listing = walk(a.folder)
            for r in index.passages(read_files(spark, listing.found), config, getattr(embedder, "tokens", word_tokens)).orderBy("position", "ord").toLocalIterator():
                page = "" if r.page is None else f" page {r.page}"
                print(f"{listing.found[r.position].path} {r.ord} [{r.char_start}, {r.char_end}){page}: {' '.join(r.text.split())[:100]}")
        elif a.command == "index":
            done = index.build(spark, a.folder, a.index_dir, embedder, config, lambda stage, n: print(f"{stage} {n}"))
            for path, reason in done.skipped:
                print(f"skipped {path}: {reason}")
            print(f"{done.documents} documents, {done.chunks} chunks, {done.seconds['total']:.1f} s")
            if done.warning:
                print(done.warning, file=sys.stderr)
        elif a.command == "search":
            rows, seconds = index.Index(spark, a.index_dir, embedder, config).search(a.query, a.k)
            for r in rows.collect():
                place = f"characters {r.char_start} to {r.char_end}" if r.page is None else f"page {r.page}"
                print(f"{r['rank']}. {r.score:.3f} {Path(r.path).name}, {place}")
                print("\n".join(f"   {line}" for line in wrap(" ".join(r.text.split())[:300], 76)))
            print(f"encode {seconds['encode'] * 1000:.1f} ms, scan {seconds['scan'] * 1000:.1f} ms")
        elif a.command == "eval":
            Path(a.out).mkdir(parents=True, exist_ok=True)
            if a.source and not index.reusable(a.index_dir, a.source, index.settings_of(embedder, config)):
                index.build(spark, a.source, a.index_dir, embedder, config)
            print(effectiveness.run_all(spark, index.Index(spark, a.index_dir, embedder, config), a.queries, a.spans, a.out, a.timing))
        else:
            from .serve import Service, serve

            server, token = serve(Service(spark, a.index_dir, embedder, config), a.port)
            print(f"http://127.0.0.1:{a.port} token {token}")
            server.serve_forever()
    except (index.IndexFault, ValueError, OSError) as e:
        print(causes(e), file=sys.stderr)
        return 1
    return 0



if __name__ == "__main__":

    try:
        sys.exit(main())
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), 1)
