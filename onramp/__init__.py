"""onramp — new-user scoring as Spark DataFrame operators.

Raw ad-touch and in-app events go in; per-user journey features, short-horizon
labels, propensity / message-response / lifetime-value scores, an explore /
exploit message policy, value tiers, an append-only prediction log and
experiment read-outs come out. Every operator takes and returns DataFrames.
"""

__version__ = "0.1.0"
