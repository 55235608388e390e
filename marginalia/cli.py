"""A thin command line: ``python -m marginalia.cli COMMAND``."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marginalia")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *aliases: str, args: tuple[str, ...] = (), flags: tuple[str, ...] = (), vault: bool = True):
        c = sub.add_parser(name, aliases=list(aliases))
        c.set_defaults(command=name)
        for a in args:
            c.add_argument(a)
        for f in flags:
            c.add_argument(f"-{f[0]}", f"--{f}", action="store_true")
        if vault:
            c.add_argument("-v", "--vault", default="")
        return c

    add("open", "o", args=("note",))
    add("daily", "d")
    add("search", "s", flags=("editor",))
    add("search-content", "sc", args=("query",), flags=("editor",))
    add("print", "p", args=("note",), flags=("mentions",))
    c = add("create", "c", args=("note",), flags=("editor",))
    c.add_argument("-c", "--content", default="")
    c.add_argument("--open", action="store_true")
    g = c.add_mutually_exclusive_group()
    g.add_argument("-a", "--append", action="store_true")
    g.add_argument("-o", "--overwrite", action="store_true")
    c = add("move", "m", args=("old", "new"), flags=("editor",))
    c.add_argument("-o", "--open", action="store_true")
    add("delete", args=("note",))
    c = add("frontmatter", "fm", args=("note",))
    for f in ("print", "edit", "delete"):
        c.add_argument(f"-{f[0]}", f"--{f}", action="store_true")
    c.add_argument("-k", "--key", default="")
    c.add_argument("--value", default="")
    add("set-default", "sd", args=("name",), vault=False)
    add("print-default", "pd", vault=False).add_argument("--path-only", action="store_true")
    return p


def choose(items: list[str]) -> int | None:
    for i, x in enumerate(items):
        print(f"{i + 1:4} {x}", file=sys.stderr)
    got = input("number: ").strip()
    return int(got) - 1 if got.isdigit() and 0 < int(got) <= len(items) else None


def main(argv: list[str] | None = None, vault=None) -> int:
    a = parser().parse_args(argv)
    from .actions import NoteError, Vault
    from .functions.paths import PathError
    from .sources.listing import VaultAccessError
    from .sources.registry import ConfigError

    if vault is None:
        from .session import session

        vault = Vault(session("local[*]", **{"spark.ui.enabled": "false"}), pick=choose)
    vault.name = getattr(a, "vault", "") or vault.name
    try:
        match a.command:
            case "open":
                vault.open(a.note)
            case "daily":
                vault.daily()
            case "search":
                vault.search(a.editor)
            case "search-content":
                if vault.search_content(a.query, a.editor) is None:
                    print(f"No notes found containing '{a.query}'")
            case "print":
                print(vault.print(a.note, a.mentions))
            case "create":
                vault.create(a.note, a.content, a.append, a.overwrite, a.open, a.editor)
            case "move":
                vault.move(a.old, a.new, a.open, a.editor)
            case "delete":
                vault.delete(a.note)
            case "frontmatter":
                print(vault.frontmatter(a.note, a.print, a.edit, a.delete, a.key, a.value))
            case "set-default":
                print(f"Default vault set to {a.name}, at {vault.set_default(a.name)}")
            case "print-default":
                if a.path_only:
                    print(vault.path(), end="")
                else:
                    print(f"Default vault name: {vault.resolve_name()}\nDefault vault path: {vault.path()}")
    except (NoteError, PathError, ConfigError, VaultAccessError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
