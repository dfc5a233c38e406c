"""The command-line jobs, one feeding the next."""

import io
import json

import pytest

from glossmill import __main__ as jobs
from glossmill.operators import bayes


def test_jobs(spark, tmp_path, capsys, monkeypatch):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "bm.txt").write_text("taara kunun dugu kɔnɔ\ntaara dugu\n", encoding="utf-8")
    (tmp_path / "fr.freq").write_text("maison 5\nbonjour 3\nbad line here\npartout x\n", encoding="utf-8")
    (tmp_path / "lex.tsv").write_text("la\tbam:3,fra:2\nhouse\teng # comment\n", encoding="utf-8")
    (tmp_path / "marked.txt").write_text("ne __bonjour madame__ taara\nodd __ mark\n\nne taara\n", encoding="utf-8")
    (tmp_path / "origins.tsv").write_text("form\torigin_lang\tsource_form\tgloss\tnotes\ndugu\tfra\tx\t\t\n", encoding="utf-8")
    jobs.main(["wordlist", "--text", f"bm={at('bm.txt')}", "--freq", f"fr={at('fr.freq')}", "--output", at("list")])
    listed = [r.value.split("\t") for r in spark.read.text(at("list")).collect()]
    assert ["taara", "bam", "2", "1.000", "bam:2"] in listed and ["maison", "fra", "5", "1.000", "fra:5"] in listed and not any(r[0] == "partout" for r in listed)
    jobs.main(["spans", "--input", at("marked.txt"), "--only-switched", "--output", at("gold")])
    jobs.main(["train", "--conll", at("gold"), "--word-list", at("list"), "--lexicon", at("lex.tsv"), "--augment", "--output", at("model")])
    jobs.main(["export", "--model", at("model"), "--output", at("model.json")])
    one, two = bayes.load(spark, at("model")), bayes.load_json(spark, at("model.json"))
    assert two.stats == one.stats and two.vocabulary == one.vocabulary
    assert sorted(map(tuple, two.grams.collect())) == sorted(map(tuple, one.grams.collect()))
    less = bayes.prune(one, 2)
    assert 0 < less.vocabulary < one.vocabulary and less.vocabulary == less.grams.count()
    capsys.readouterr()
    jobs.main(["identify", "taara", "bonjour", "dugu", "!", "--model", at("model.json"), "--lexicon", at("lex.tsv"), "--origins", at("origins.tsv"), "--json"])
    found = json.loads(capsys.readouterr().out)
    assert [t["text"] for t in found] == ["taara", "bonjour", "dugu", "!"] and found[2]["origin_lang"] == "fra" and found[3]["label"] == "univ"
    jobs.main(["identify", "--input", at("bm.txt"), "--model", at("model"), "--words"])
    assert len(capsys.readouterr().out.splitlines()) == 6
    jobs.main(["identify", "", "--model", at("model")])
    assert capsys.readouterr().out.strip() == "(no words)"
    monkeypatch.setattr("sys.stdin", io.StringIO("taara dugu\nbonjour\n"))
    jobs.main(["identify", "--model", at("model"), "--json"])
    assert [[t["text"] for t in json.loads(x)] for x in capsys.readouterr().out.splitlines()] == [["taara", "dugu"], ["bonjour"]]
    (tmp_path / "a.txt").write_text("taara kunun dugu\nkunun taara\n\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("bonjour madame\nla maison\nx\n", encoding="utf-8")
    jobs.main(["benchmark", "--host", at("a.txt"), "--guest", at("b.txt"), "--model", at("model")])
    said = capsys.readouterr().out
    assert all(x in said for x in ("bam-inf", "cs-synth", "macro_acc"))
    (tmp_path / "t.jsonl").write_text('{"bm": "taara dugu", "fr": "maison"}\n{"bm": null, "fr": "maison"}\n', encoding="utf-8")
    jobs.main(["wordlist", "--table", at("t.jsonl"), "--col", "bm=bm", "--col", "fr=fr", "--output", at("list2")])
    assert ["maison", "fra", "2", "1.000", "fra:2"] in [r.value.split("\t") for r in spark.read.text(at("list2")).collect()]
    (tmp_path / "p.jsonl").write_text('{"src": "good", "tgt": "ka nyi", "src_lang": "en", "tgt_lang": "bm"}\n', encoding="utf-8")
    jobs.main(["wordlist", "--table", at("p.jsonl"), "--col", "bm=bm", "--output", at("list3")])
    assert spark.read.text(at("list3")).count() == 4
    build = ["build", "--text", f"bm={at('bm3.txt')}", "--freq", f"fr={at('fr.freq')}", "--output", at("built")]
    (tmp_path / "bm3.txt").write_text("taara kunun\n" * 3, encoding="utf-8")
    jobs.main(build)
    first = (tmp_path / "built" / "words" / "_SUCCESS").stat().st_mtime_ns
    jobs.main(build)
    assert (tmp_path / "built" / "words" / "_SUCCESS").stat().st_mtime_ns == first and bayes.load_json(spark, at("built/model.json")).vocabulary
    with pytest.raises(SystemExit):
        jobs.main(["identify", "x", "--model", at("model.bin")])
    one = [r.value for r in spark.read.text(at("gold")).collect()]
    assert one[0].startswith("# ")
    jobs.main(["evaluate", "--gold", at("gold"), "--model", at("model"), "--lexicon", at("lex.tsv")])
    assert "accuracy" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        jobs.main(["wordlist", "--text", "xx=nowhere", "--output", at("none")])
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        bayes.load_json(spark, at("bad.json"))
