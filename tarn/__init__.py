"""tarn: industry-intelligence analytics and training-data preparation on Spark."""
