"""Write a whole plan."""

from __future__ import annotations

from plantcast.plans.backward import BackwardPlan
from plantcast.plans.forward import ForwardPlan
from plantcast.sources.store import remove_folder, work_folder, write_tables


def publish(plan: BackwardPlan | ForwardPlan, path: str) -> None:
    """Compute the shared tables once, check them for missing inputs, and write every report below ``path``.

    The shared tables go to the folder of ``spark.checkpoint.dir`` and are removed afterwards, so
    the plan object is not used again. The check reads what is written, not the order lines.
    """
    spark = plan.sources.orders.sparkSession
    folder = work_folder(spark, "plan")
    try:
        plan.stage(folder)
        plan.require_inputs(plan.products)
        write_tables({name: getattr(plan, name) for name in plan.REPORTS}, path)
    finally:
        remove_folder(spark, folder)
