"""The supplier and nation tables as a small program in four languages, so that extraction and resolution run on any scale
of data and have an SQL twin: a file for each supplier and language, and one for each nation that they import from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.star import table

#: Path, language and text of each file; {s} is the supplier, {n} its nation.
OF_SUPPLIER = [
    (
        "n{n}/s{s}.py", "python",
        "from n{n}.base import Base{n} as B\nimport json\n\n\nclass Sup{s}(B):\n    def run(self):\n        return self.step()\n\n    def step(self):\n        return helper{s}()\n\n\n"
        "def helper{s}():\n    b = B()\n    b.ping()\n    print(json.dumps(1))\n    return missing{s}.go()\n",
    ),
    (
        "web/n{n}/w{s}.ts", "typescript",
        "import { Item{n} } from './item.js';\nexport class Store{s} {\n  private item: Item{n};\n  load(): void { this.item.show(); this.clear(); }\n  clear(): void { new Item{n}(); }\n}\n",
    ),
    (
        "java/n{n}/J{s}.java", "java",
        "package n{n};\npublic class J{s} extends Repo{n} {\n  private Repo{n} repo;\n  public void save() { repo.put(); }\n}\n",
    ),
    ("web/n{n}/p{s}.html", "html", "<div id=\"root\"></div><script src=\"./w{s}.ts\"></script>"),
]
OF_NATION = [
    ("n{n}/base.py", "python", "class Base{n}:\n    def ping(self):\n        return 1\n"),
    ("web/n{n}/item.ts", "typescript", "export class Item{n} { show(): void { console.log('x'); } }\n"),
    ("java/n{n}/Repo{n}.java", "java", "package n{n};\npublic class Repo{n} {\n  public void put() { }\n}\n"),
]

#: A second program of each supplier: routes, models, services and visibility as frameworks and languages have them, and a file with an error.
FEATURES = [
    (
        "api/s{s}.py", "python",
        "class Row{s}(Base):\n    __tablename__ = 'rows{s}'\n\n\n@app.get(\"/s/{s}\")\ndef read{s}():\n    return 1\n\n\n@bp.route(\"/f/{s}\", methods=[\"POST\", \"PUT\"])\ndef save{s}():\n    return 2\n\n\n"
        "def _own{s}():\n    pass\n\n\ndef __very{s}():\n    pass\n",
    ),
    (
        "nest/c{s}.ts", "typescript",
        "@Controller('n/{s}')\nexport class Desk{s} {\n  @Get('all')\n  all(): void { }\n  #hidden(): void { }\n}\n@Injectable()\nclass Mail{s} { }\n",
    ),
    ("web/r{s}.js", "javascript", "function show{s}() { }\nconst list{s} = () => { };\napp.get('/e/{s}', show{s});\nrouter.post('/e/{s}', list{s});\n"),
    ("ui/v{s}.jsx", "jsx", "import { Box{s} } from './box{s}.js';\nexport function View{s}() { return <div><Box{s} /></div>; }\n"),
    ("ui/box{s}.js", "javascript", "export function Box{s}() { }\n"),
    ("jv/K{s}.java", "java", "public class K{s} {\n  private int a;\n  protected void b() { }\n  void c() { }\n}\n"),
    ("bad/b{s}.py", "python", "def good{s}():\n    return 1\n\n\ndef bad{s}(:\n    return 2\n\n\ndef last{s}():\n    return good{s}()\n"),
]


def _filled(form: str, **keys: str):
    out = F.lit(form)
    for k, column in keys.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.col(column).cast("string"))
    return out


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the second program, as `sources` gives those of the first."""
    return _files([(table(spark, sf_dir, "supplier"), FEATURES, {"s": "s_suppkey"})])


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, language, source, content_hash, ordinal) of the program's files."""
    return _files(
        [
            (table(spark, sf_dir, "supplier"), OF_SUPPLIER, {"s": "s_suppkey", "n": "s_nationkey"}),
            (table(spark, sf_dir, "nation"), OF_NATION, {"n": "n_nationkey"}),
        ]
    )


def _files(parts: list[tuple[DataFrame, list[tuple[str, str, str]], dict[str, str]]]) -> DataFrame:
    made = []
    for rows, forms, keys in parts:
        for path, lang, text in forms:
            made.append(rows.select(_filled(path, **keys).alias("file_path"), F.lit(lang).alias("language"), _filled(text, **keys).alias("source")))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    # any order of files will do, as long as it is one
    return out.withColumn("content_hash", F.sha1("source")).withColumn("ordinal", F.pmod(F.xxhash64("file_path"), F.lit(1 << 42)))
