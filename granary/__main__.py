"""python -m granary FILE.sql [FOLDER]: runs a program over the tables of a folder and prints its results as JSON. Beside the file its syntax tree is left as FILE_ast.json."""

from __future__ import annotations

import json
import sys
from pathlib import Path

from granary.engine import Database
from granary.plans.dialect import LexicalError, ParserError, parse, syntax_json, tokens
from granary.session import session


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    source = Path(args[0]).read_text(encoding="utf-8")
    try:
        for t in tokens(source):
            print(t)
        Path(args[0]).with_name(f"{Path(args[0]).stem}_ast.json").write_text(syntax_json(parse(source)), encoding="utf-8")
    except (LexicalError, ParserError) as e:
        print(e)
    folder = args[1] if len(args) > 1 else "tables"
    out = Database(session(), folder, uploads=Path(args[0]).parent).execute(source)
    print(json.dumps(out, indent=2, ensure_ascii=False))
    return 0 if out["success"] else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
