"""Token economics of language model usage logs as Spark jobs, and a training-data toolkit (llm)."""
