"""A few sources that tests compare."""

from graftwork.operators import lint

_RS = "fn check(p: &str) -> Option<i32> {\n    if p != null {\n        guard.lock();\n        return helper(p);\n    }\n    None\n}\n\nfn helper(p: &str) -> i32 {\n    let total = 1;\n    total + 2\n}\n"
_RS2 = "fn check(p: &str) -> Result<i32> {\n    return helper(p);\n}\n\nfn assist(p: &str) -> i32 {\n    let total = 1;\n    total + 2\n}\n"
_PY = "def load(path):\n    data = read(path)\n    return data\n\n\ndef read(path):\n    return open(path)\n"
_PY2 = "def load(path):\n    data = read(path)\n    if data == None:\n        return []\n    return data\n"
_JS = "function area(w, h) { const x = w * h; return x; }\nfunction main() { return area(2, 3); }\n"
_JS2 = "function area(w, h) { const y = w * h; return y; }\nfunction main() { return area(2, 3); }\nfunction extra() { panic(); return main(); }\n"
#: commit, file_path, lang, old_text, new_text
PAIRS = (
    ("c1", "src/check.rs", "rust", _RS, _RS2),
    ("c1", "app/load.py", "python", _PY, _PY2),
    ("c1", "app/read.py", "python", None, "def read(path):\n    return open(path)\n"),
    ("c2", "web/area.js", "javascript", _JS, _JS2),
    ("c2", "web/same.js", "javascript", _JS, _JS),
    ("c2", "conf.json", "json", '{"port": 8080, "name": "a"}', '{"port": 3000, "name": "a"}'),
    ("c3", "Main.java", "java", "class Main { int run(int a) { return a; } }", None),
    ("c4", "pad.c", "c", "int f(int a) { return a; }", "int f(int a)   {\n  return a;\n}\n"),
)
RULES = [lint.Rule("no_panic", "ERROR", "panic in $file at $line", "(identifier) @p"), lint.Rule("no_open", "WARN", "open in $file at $line", "(identifier) @o")]


def pairs(spark):
    return spark.createDataFrame(PAIRS, "commit STRING, file_path STRING, lang STRING, old_text STRING, new_text STRING")
