"""Every query against its SQL on the smallest tables, and the entry point without the corpus operators."""

import os
import subprocess
import sys

import duckdb
import pytest

from strophe import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def rows(names, values):
    """Rows as text, so that 1 and 1.0 differ but integer widths do not."""
    return sorted(tuple(str(dict(zip(names, v))[n]) for n in sorted(names)) for v in values)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    r = duck.execute(plans.SQL[name])
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows([d[0] for d in r.description], r.fetchall())


KERNELS = {
    "aligned_components", "aligned_lmeasure", "balanced_labels", "beam_hierarchical", "best_segments", "block_model", "cascade_steps", "component_chains", "constrained_components", "corpus_run", "divided_layers", "filled_components", "filter_segments", "flanked_profile", "flat_labels",
    "grammar_probability", "hierarchical_patterns", "laplacian_labels", "layered_labels", "lowess", "lowess_loo_band", "make_hierarchical", "maximal_cliques", "most_salient", "neighbour_choices", "onset_hist_peaks", "optics_clusters", "pattern_cascade", "pair_induction",
    "partner_sweep", "preprocessed", "profile_likelihoods", "profile_msa", "prune_components", "prune_rows", "prune_worst_rows", "realigned_gaps", "reinforced_segments", "rival_segments", "salient_labels", "section_layers", "section_trees", "sections_by_coverage", "short_sections",
    "similar_parts", "simple_structure", "simplified_form", "smith_waterman", "smoothed_labels", "supported_components", "sw_similarity", "trained_profile", "transitive_construction", "transitivity_of_order", "trim_components",
}


def test_queries_without_sql_are_sequential_algorithms():
    assert set(plans.QUERIES) - set(plans.SQL) == KERNELS


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_sequential_algorithms_give_rows_again_and_again(spark, name):
    a, b = [sorted(map(str, plans.QUERIES[name](spark, SF).collect())) for _ in range(2)]
    assert a and a == b


def test_entry_imports_without_the_corpus_operators(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['strophe.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=repo)
