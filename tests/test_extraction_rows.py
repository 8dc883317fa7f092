"""The queries of the extraction: what a file costs, how files are dealt, and that each is scanned once."""

import re
import time

import pytest

from loomgraph.operators import extract, truth
from loomgraph.plans import extraction_rows

SF = "/root/testdata/sf0.001"


def _least(run, times=7):
    took = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return min(took)


@pytest.mark.parametrize("domain", ["columns", "symbols", "calls", "branches", "config", "nats"])
def test_a_scan_costs_a_few_passes_over_the_text(domain):
    """In units of one pass by character in Python; before, a scan took 25 (config) to 35 (calls) of them, now 3 to 10."""
    texts = [extraction_rows.LEAD * (p % 5) + extraction_rows.SOURCE.replace("{p}", str(p)) for p in range(40)]
    scan = _least(lambda: [list(extract.scan("a.ts", t, [domain], {})) for t in texts])
    assert scan < 18 * _least(lambda: [[c for c in t if c != "~"] for t in texts])


def test_client_names_as_a_pattern_finds_them():
    text = "x1: ClientProxy, a1b ?: NatsConnection, éc\n!\n:\tClientNats, ClientProxy$: ClientNats, 1_d: ClientProxyX, e?? : ClientProxy, f: ClientProxy: ClientNats"
    assert extract.client_names(text) == {"x1", "a1b", "c", "ClientProxy$", "f"}
    long = "a" * 200_000
    assert extract.client_names(f"{long} {long}: ClientProxy") == {long}


def test_scanning_by_patterns_keeps_odd_brackets_strings_and_comments():
    assert extract.strip_comments("a /*/ b */ c '/*' // d\n\"//\" `\n// e` /* f\ng") == "a          c '/*'     \n\"//\" `\n// e`     \n "
    assert extract.balanced("([)]{'}'})x", 0) == 10 and extract.balanced("(]' (", 0) == 5 and extract.balanced("({[]})", 1) == 5
    assert extract.split_args("a, ')', [b, c], 'd") == ["a", "')'", "[b, c]", "'d"] and extract.split_args(" ") == [] and extract.split_args("a,") == ["a", ""]


def test_files_are_dealt_to_all_cores(spark):
    assert extraction_rows.source_files(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_domain_recall_scans_each_file_once(spark):
    plan = extraction_rows.domain_recall(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("MapIn" in line and line.lstrip(" :+-")[0] != "(" for line in plan.split("\n")) == 1


def test_sites_by_role_counts_a_module_once_and_repeated_files_each_time(spark):
    files = spark.createDataFrame([("a.ts", "@Module({imports: [A, B]}) class M {}\nfetch('/x')")] * 2, "file string, text string")
    found = truth.sites_by_role(extract.extract(files, ["di-modules", "http"])).groupBy("domain").count().collect()
    assert {r["domain"]: r["count"] for r in found} == {"di": 1, "http": 2}


def test_every_pattern_of_the_truth_has_words_that_its_matches_hold(spark):
    """Each pattern in all its spellings, on lines of its own: as many matches as the patterns find without a look at the words."""
    text = "\n".join([
        "@MessagePattern ('a')", "@EventPattern('a')", "this.natsBus.publish<A>('x'); aClientB.request ('y')", "client.send('a'); client.emit('a')", "@RabbitSubscribe({})", "@RabbitRPC({})", "@RmqHandler()", "@InjectRepository(A)", "@Entity ('a')",
        "@InjectQueue('a')", "@Processor('a')", "BullModule.registerQueueAsync({})", "BullModule.registerQueue({})", "@Cron('a')", "@Interval(1)", "@Timeout(1)", "@Module({})", "axios ('a'); fetch<A>('b'); httpService.get('c')", "export * from \"a\"",
        *[f"@{v}('a')" for v in ("Get", "Post", "Put", "Patch", "Delete", "All", "Options", "Head", "Sse")], "process.env['A'] + process.env.B", "appConfig.get('a'); config.getOrThrow<A>('b')",
        *[f"@{v}()" for v in ("Column", "PrimaryColumn", "PrimaryGeneratedColumn", "CreateDateColumn", "UpdateDateColumn", "DeleteDateColumn")], "function Card<A>() {}", "const useX = 1; function useY() {}",
    ])
    want = sorted((d, r, n, m[0]) for n, line in enumerate(text.split("\n"), 1) for (d, r), p in truth.PATTERNS.items() for m in re.finditer(p, line))
    assert {x[:2] for x in want} == set(truth.PATTERNS) == set(truth.WORDS)
    found = truth.truth(spark.createDataFrame([("a.ts", text)], "file string, text string"))
    assert sorted((r["domain"], r["role"], r["line"], r["matched_text"]) for r in found.collect()) == want
