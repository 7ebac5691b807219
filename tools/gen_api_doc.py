"""Write docs/API.md: every public function of the library with its signature and summary line."""

from __future__ import annotations

import importlib
import inspect
import os
import pkgutil
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import tallyspark  # noqa: E402


def main() -> None:
    out = ["# API", "", "Public functions and classes of `tallyspark`, by module (generated by `tools/gen_api_doc.py`).", ""]
    for info in sorted(pkgutil.walk_packages(tallyspark.__path__, "tallyspark."), key=lambda m: m.name):
        mod = importlib.import_module(info.name)
        items = []
        for name, obj in vars(mod).items():
            if name.startswith("_") or getattr(obj, "__module__", None) != mod.__name__:
                continue
            if inspect.isfunction(obj) or inspect.isclass(obj):
                doc = (inspect.getdoc(obj) or "").split("\n\n")[0].replace("\n", " ")
                try:
                    sig = str(inspect.signature(obj))
                except (TypeError, ValueError):
                    sig = "(...)"
                sig = re.sub(r"Params\([^)]*\([^)]*\)[^)]*\)|Params\(.*?\)(?=[,)])", "DEFAULT", sig)
                items.append(f"* `{name}{sig}` -- {doc}" if doc else f"* `{name}{sig}`")
        if items:
            summary = (inspect.getdoc(mod) or "").split("\n\n")[0].replace("\n", " ")
            out += [f"## `{info.name}`", "", summary, ""] + items + [""]
    with open(os.path.join(ROOT, "docs", "API.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
