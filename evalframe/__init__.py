"""Analytics over language-model evaluation logs, as Spark DataFrame operators."""
