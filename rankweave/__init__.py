"""rankweave: hybrid matching, ranking and corpus analytics as PySpark DataFrame plans."""
