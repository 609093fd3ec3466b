"""refbank: template-driven extraction analytics as Spark DataFrame jobs.

Every operator takes and returns DataFrames keyed by ``template_id`` /
``input_id`` so one plan serves many templates and many documents at once.
"""

from refbank.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
