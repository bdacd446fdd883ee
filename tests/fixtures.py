"""The small store used by several tests."""

FIBERS = [("d0", "chr1", 0, "fiber1", 100, 2100), ("d0", "chr1", 1, "fiber2", 5000, 8000)]
NUC = [(0, 150, 300, 150, -1.0), (0, 350, 500, 150, 50.0), (0, 550, 700, 150, 50.0), (1, 5100, 5250, 150, -1.0), (1, 5300, 5450, 150, 50.0)]
M5C = [(0, 200, 0.9, True), (0, 400, 0.1, False), (0, 600, 0.8, True), (0, 800, 0.2, False), (1, 5200, 0.95, True), (1, 5400, 0.3, False)]
MSP = [(0, 100, 200, 100), (0, 600, 750, 150), (1, 5100, 5400, 300)]
FIRE = [(0, 120, 180, 60, 0.05, "H1"), (0, 650, 760, 110, 1.01, "H1"), (1, 5200, 5300, 100, 0.25, "UNK")]
REGIONS = [("Typical_Enhancer", "chr1", 400, 700, "Typical_Enhancer_1", 0), ("Typical_Enhancer", "chr1", 4900, 5500, "Typical_Enhancer_2", 1), ("CGI", "chr1", 150, 850, "CGI_1", 2)]


def fibers(spark, extra=()):
    return spark.createDataFrame([*FIBERS, *extra], "sample string, chrom string, fiber_int_id long, fiber_id string, start long, end long")


def regions(spark, extra=()):
    return spark.createDataFrame([*REGIONS, *extra], "annotation string, chrom string, start long, end long, id string, ord long")


def layers(spark):
    def make(rows, names):
        return spark.createDataFrame([("d0", "chr1", *r, i) for i, r in enumerate(rows)], f"sample string, chrom string, fiber_int_id long, {names}, ord long")

    return {
        "nucleosomes": make(NUC, "start long, end long, width long, linker float"),
        "5mC": make(M5C, "pos long, prob float, is_methylated boolean"),
        "msp": make(MSP, "start long, end long, width long"),
        "fire_accessibility": make(FIRE, "start long, end long, width long, score double, haplotype string"),
    }
