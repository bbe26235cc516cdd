"""logtrail: security-log timelines and threat detection as Spark DataFrame operators."""
