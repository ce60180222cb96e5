import json
import re
import shutil
import subprocess

import pytest

from weft.operators.render import render_html

PAYLOAD = {
    "nodes": [{"id": i, "name": i.split(":")[1], "label": i.split(":")[1], "type": i.split(":")[0], "file_path": None, "line_number": None, "metadata": {}} for i in ("t:raw.a", "f:x", "f:y", "t:gold.b", "t:alone")],
    "edges": [{"source": s, "target": t, "type": "read_by", "confidence": "high", "evidence": None, "metadata": {}} for s, t in (("t:raw.a", "f:x"), ("f:x", "f:y"), ("f:y", "f:x"), ("f:y", "t:gold.b"))],
    "asset_types": ["t"], "asset_edges": [{"source": "t:raw.a", "target": "t:gold.b", "type": "depends_on", "confidence": "high", "evidence": "asset projection", "metadata": {"via": ["f:x", "f:y"]}}], "includes_source": False,
}

# just enough of a document for the page's script, and what it finds in three states
STUB = """
const made = {};
const item = () => ({ value: "", checked: false, textContent: "", style: {}, attributes: {}, children: [], append(...x) { this.children.push(...x); }, appendChild(x) { this.children.push(x); }, setAttribute(k, v) { this.attributes[k] = v; } });
const document = { getElementById: (id) => (made[id] ||= item()), createElement: item, createElementNS: item };
document.getElementById("mode").value = "assets"; document.getElementById("highlight").value = "impact";
"""
ASK = """
const shown = () => visible().nodes.map((n) => n.id).sort();
const report = { assets: shown() };
byId("mode").value = "detail"; report.detail = shown();
const c = columns(visible()); report.order = c.get("t:raw.a") < c.get("f:x") && c.get("f:y") < c.get("t:gold.b");
picked.node = "f:y"; report.impact = [...highlighted(visible())].sort();
byId("focus").onclick(); report.component = shown(); byId("reset").onclick();
picked.layers.add("gold"); report.gold = shown(); byId("context").checked = true; report.around = shown();
picked.layers.clear(); picked.edge = data.asset_edges[0]; made.info.children = []; draw(); report.path = made.info.children.map((x) => x.textContent).filter((x) => x);
console.log(JSON.stringify(report));
"""


def test_the_page_needs_nothing_from_outside():
    page = render_html(PAYLOAD, "a <b> & c")
    assert "<title>a &lt;b&gt; &amp; c</title>" in page and "http" not in page.replace("http://www.w3.org/2000/svg", "") and "__" not in re.sub(r"\w__|__\w", "", page)


@pytest.mark.skipif(shutil.which("node") is None, reason="no JavaScript runtime")
def test_filters_focus_highlight_and_inspector():
    script = re.search(r"<script>(.*)</script>", render_html(PAYLOAD), re.S).group(1)
    out = subprocess.run(["node", "-"], input=STUB + script + ASK, capture_output=True, text=True, timeout=60)
    got = json.loads(out.stdout or "null") or pytest.fail(out.stderr[:800])
    assert got["assets"] == ["t:alone", "t:gold.b", "t:raw.a"] and len(got["detail"]) == 5 and got["order"]
    assert got["impact"] == ["f:x", "f:y", "t:gold.b"] and got["component"] == ["f:x", "f:y", "t:gold.b", "t:raw.a"]
    assert got["gold"] == ["t:gold.b"] and got["around"] == ["f:y", "t:gold.b"]
    assert got["path"][:5] == ["asset projection", "raw.a", "x", "y", "gold.b"]
