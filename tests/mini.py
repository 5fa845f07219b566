"""A small code base as an index: who defines, references and imports what."""

from codeloom.operators.model import DEFINITION, IMPORT, REFERENCE, SCHEMAS, Index

HEAD = "scip-typescript npm test 1.0 "


class Builder:
    def __init__(self):
        self.docs, self.chunks, self.symbols, self.mentions, self.ranges = {}, [], {}, [], []

    def file(self, path):
        self.docs[path] = len(self.docs) + 1
        self.chunks.append((self.docs[path], self.docs[path], 0, 0, 200, None))
        return self

    def symbol(self, path, tail):
        folder, name = path.rsplit("/", 1)
        text = f"{HEAD}{folder}/`{name}`/{tail}"
        self.symbols.setdefault(text, len(self.symbols) + 1)
        return self.symbols[text]

    def define(self, path, tail, start=1, end=3):
        ident = self.symbol(path, tail)
        self.ranges.append((len(self.ranges) + 1, self.docs[path], ident, start, 0, end, 0))
        if tail:
            self.mentions.append((self.docs[path], ident, DEFINITION))
        return self

    def use(self, path, home, tail, role=REFERENCE):
        self.mentions.append((self.docs[path], self.symbol(home, tail), role))
        return self

    def index(self, spark, lines=None):
        rows = {
            "documents": [(i, p) for p, i in self.docs.items()], "chunks": self.chunks, "symbols": [(i, s, None, None) for s, i in self.symbols.items()],
            "mentions": sorted(set(self.mentions)), "ranges": self.ranges,
        }
        source = spark.createDataFrame(lines, "relative_path string, line_no long, text string") if lines is not None else None
        return Index(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}, source_lines=source)


def code_base():
    b = Builder()
    for path in ("src/lib.ts", "src/consumer.ts", "src/dead.ts", "src/a.ts", "src/b.ts", "src/c.ts", "src/lazy.ts", "tests/harness.ts", "src/only.ts"):
        b.file(path)
    b.define("src/lib.ts", "foo().").use("src/consumer.ts", "src/lib.ts", "foo().").use("src/consumer.ts", "src/lib.ts", "foo().", IMPORT)
    b.define("src/lib.ts", "Bar#", 5, 9).define("src/lib.ts", "Bar#go().", 6, 7).use("src/consumer.ts", "src/lib.ts", "Bar#").use("src/consumer.ts", "src/lib.ts", "Bar#go().")
    b.define("src/lib.ts", "sameFileHelper().", 20, 29).use("src/lib.ts", "src/lib.ts", "sameFileHelper().")
    b.define("src/lib.ts", "testOnlyFn().", 30, 31).use("tests/harness.ts", "src/lib.ts", "testOnlyFn().")
    b.define("src/lib.ts", "_private().", 40, 41)
    b.define("src/dead.ts", "deadFn().", 0, 9).use("src/consumer.ts", "src/dead.ts", "deadFn().", IMPORT)
    b.define("src/dead.ts", "Orphan#", 11, 12).define("src/dead.ts", "ghost().", 14, 18).define("src/dead.ts", "CardProps#", 20, 21)
    for one, two in (("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")):
        b.define(f"src/{two}.ts", f"{two}{one}().") and b.use(f"src/{one}.ts", f"src/{two}.ts", f"{two}{one}().")
    b.define("src/lazy.ts", "", 0, 200).define("src/lazy.ts", "Page#", 2, 8).use("src/consumer.ts", "src/lazy.ts", "", IMPORT)
    b.define("src/only.ts", "aliased().", 1, 2).symbol("src/only.ts", "aliased0:")
    b.use("src/consumer.ts", "src/only.ts", "aliased0:")
    return b
