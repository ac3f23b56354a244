"""check: validates and repairs one payload file. Exit 0: valid or repaired; 1: in part; 2: failed, or bad input; 3: ambiguous."""

from __future__ import annotations

import argparse
import json
import sys

from .contract import VERSION, Config, parse_contract
from .operators.checks import check
from .operators.guard import told
from .operators.repair import policy_of, repair

EXITS = {"already_valid": 0, "success": 0, "partial": 1, "failed": 2, "ambiguous": 3}


def _load(path: str):
    with open(path, encoding="utf-8-sig") as f:
        return json.load(f)


def _text(row: dict) -> str:
    lines = [f"status: {row['status']}"]
    for title, part in (("violations", row["initial"]), ("remaining", row["remaining"])):
        lines += [f"{title}:", *(f"  {v['severity']} {v['kind']} at '{v['path']}'" for v in part)] if part else []
    for a in row["attempts"]:
        lines.append(f"attempt {a['number']}: {a['strategy']}")
        lines += [f"  {what} {o['op']} '{o['target']}'" + (f" from '{o['source']}'" if o["source"] else "") + f" trust {o['trust']:.3f}" for what in ("applied", "rejected", "abstained") for o in a[what]]
    for m in row["ambiguous"]:
        lines.append(f"ambiguous '{m['target']}': {m['reason']}")
    return "\n".join([*lines, f"payload: {row['repaired']}"] if row["repaired"] is not None else lines)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pactline")
    parser.add_argument("--version", action="version", version=f"pactline {VERSION}")
    command = parser.add_subparsers(dest="command", required=True).add_parser("check", help="validate and repair one payload")
    given = command.add_mutually_exclusive_group(required=True)
    given.add_argument("--model", help="module.path:Class of a Pydantic model")
    given.add_argument("--schema", help="JSON file of a contract")
    command.add_argument("--payload", required=True)
    command.add_argument("--json", action="store_true")
    command.add_argument("--strict", action="store_true")
    command.add_argument("--max-attempts", type=int, default=Config.max_attempts)
    command.add_argument("--confidence-threshold", type=float, default=Config.minimum_trust)
    asked = parser.parse_args(args)
    try:
        config = Config(max_attempts=asked.max_attempts, minimum_trust=asked.confidence_threshold, strict=asked.strict)
        payload = _load(asked.payload)
        if asked.model:
            from .sources.models import ModelCheck, contract_of_model, load

            model = load(asked.model)
            contract, checker = contract_of_model(model), ModelCheck(model)
        else:
            contract, checker = parse_contract(_load(asked.schema)), check
    except (OSError, ValueError, TypeError, KeyError, ImportError, AttributeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    policy = policy_of(config)
    contract = contract.with_strict(config.strict)
    row = told(repair(contract, payload, config, policy=policy, checker=checker), policy)
    print(json.dumps(row | {"contract_id": contract.contract_id}, ensure_ascii=False) if asked.json else _text(row))
    return EXITS[row["status"]]


if __name__ == "__main__":
    sys.exit(main())
