"""Section quality control, sampling and delivery for serial-section image volumes, as Spark DataFrame jobs."""
