"""replenish — inventory-planning analytics on Spark DataFrames.

Typical use::

    from replenish.sources.tables import load_inputs        # or read_canonical
    from replenish.operators import panel, compare
    from replenish.plans import pipeline

    demand, items = load_inputs(spark, "/data/tpch")
    settled = panel.policy_panel(demand, items)             # both policies, settled
    compare.plan_comparison(settled).show()
    pipeline.run(spark, demand, items, pipeline.Output(database="planning", buckets=512))

Layout: ``functions`` holds Column factories, ``operators`` DataFrame steps,
``sources`` the input readers, ``plans`` the registered queries, their SQL
oracle, the dashboard datasets and the persisted job, ``streaming`` the
incremental settlement.
"""
