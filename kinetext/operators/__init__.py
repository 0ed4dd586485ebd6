"""DataFrame operators: sentences, embeddings, kinematics, scores, comparison, classification, drift, projections."""
