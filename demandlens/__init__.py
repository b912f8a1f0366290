"""demandlens: Spark-native evaluation of per-product demand forecasts.

Every public function maps DataFrames to DataFrames and stays lazy; nothing
loops over products on the driver.  The sub-packages are

* ``functions``  - column expressions (calendar, discount, bins, errors)
* ``operators``  - window features, scaling, scoring, calibration, reports
* ``sources``    - readers, writers and the test-data panel
* ``plans``      - end-to-end evaluation and comparison jobs
* ``llm``        - operators for training-data pipelines, apart from the rest
"""

from demandlens.plans.linear import evaluate_linear
from demandlens.plans.sequence import evaluate_sequence
from demandlens.plans.comparison import compare_models

__all__ = ["evaluate_linear", "evaluate_sequence", "compare_models"]
