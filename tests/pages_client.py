"""A client of pages that lie in a folder, which counts what is asked of it."""

from __future__ import annotations

import json
import os


class Folder:
    def __init__(self, at):
        self.at = at

    def _load(self, token):
        with open(f"{self.at}/{token or 0}.json") as f:
            return json.load(f)

    def head(self, token):
        with open(f"{self.at}/asked", "a") as f:
            f.write(f"head {token}\n")
        if os.path.exists(f"{self.at}/move"):  # the list changes while it is walked
            with open(f"{self.at}/move") as f:
                left = int(f.read())
            page = self._load(token)
            if token and left:
                with open(f"{self.at}/move", "w") as f:
                    f.write(str(left - 1))
                page["generation"] = f"moved {left}"
        else:
            page = self._load(token)
        ids = [r["id"] for r in page["rows"]]
        return page["generation"], page["next"], min(ids, default=None), max(ids, default=None)

    def page(self, token):
        with open(f"{self.at}/asked", "a") as f:
            f.write(f"page {token}\n")
        page = self._load(token)
        return page["generation"], page["rows"]


def folder(at):
    return Folder(at)
