import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from foliospark.config import OFFLINE_ENVIRONMENT, Settings, enforce_offline
from foliospark.operators import providers, semantic
from foliospark.plans import ingest
from foliospark.sources import decoders


def test_offline_policy():
    for name in ("embedding_provider", "llm_provider"):
        for value in ("azure", "Azure"):
            with pytest.raises(ValueError, match="off-machine"):
                Settings(offline=True, **{name: value})
    assert Settings(offline=True).offline and not Settings().offline
    env = {"TRANSFORMERS_OFFLINE": "0"}
    assert enforce_offline(env).keys() == OFFLINE_ENVIRONMENT.keys() - {"TRANSFORMERS_OFFLINE"} and env["TRANSFORMERS_OFFLINE"] == "0" and env["HF_HUB_OFFLINE"] == "1"


def test_providers_need_what_they_need():
    with pytest.raises(ValueError, match="azure_openai_endpoint"):
        providers.vectors(Settings(embedding_provider="azure"))
    with pytest.raises(ValueError, match="unknown"):
        providers.answers(Settings(llm_provider="nobody"))
    with pytest.raises(ValueError, match="no embedder"):
        semantic.embedder(Settings(embedding_provider="nobody"))


def test_local_language_model():
    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = json.dumps({"response": json.dumps([asked["model"], asked["prompt"]])}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = providers.answers(Settings(ollama_base_url=f"http://127.0.0.1:{server.server_port}", ollama_model="m"))
    assert json.loads(ask("lines")) == ["m", "lines"]
    server.shutdown()


def test_second_ingest_embeds_nothing(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    # a deck is enough to have prose to split: its one slide is above the limit
    words = " ".join(f"Sentence number {k} of the slide says something." for k in range(60))
    with zipfile.ZipFile(tmp_path / "in" / "a.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:sdt><w:sdtContent><w:p><w:r><w:t>{words}</w:t></w:r></w:p></w:sdtContent></w:sdt></w:body></w:document>')
    embedded = spark.sparkContext.accumulator(0)

    def counting(cfg):
        def embed(text):
            @F.udf("array<double>")
            def run(x):
                embedded.add(1)
                return semantic.hashed_vector(x)

            return run(text)

        return embed

    monkeypatch.setitem(semantic.EMBEDDERS, "counted", counting)
    cfg = Settings(embedding_provider="counted", cache_dir=str(tmp_path / "cache"), max_child_tokens=60)
    first = ingest.ingest_folder(spark, str(tmp_path / "in"), cfg)
    texts = sorted(r["text"] for r in first.chunks.collect())
    assert embedded.value == 60 and len(texts) > 3
    second = ingest.ingest_folder(spark, str(tmp_path / "in"), cfg)
    assert sorted(r["text"] for r in second.chunks.collect()) == texts and embedded.value == 60


def test_dates_of_sheets():
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{s}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="20"/></cellXfs></styleSheet>')
        cells = "".join(f'<c r="{c}1" s="{k}"><v>{v}</v></c>' for c, k, v in (("A", 0, 45000), ("B", 1, 45000), ("C", 2, 45000.5), ("D", 3, 2.5), ("E", 4, 0.25)))
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1">{cells}</row></sheetData></worksheet>')
    assert decoders.decode_xlsx(out.getvalue(), "a.xlsx").sheets == [("a", [["45000", "2023-03-15 00:00:00", "2023-03-15 12:00:00", "2.5", "06:00:00"]])]
