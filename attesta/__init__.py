"""Evidence-based matching on Spark: claims about subjects, gates with reasons, explainable scores."""
