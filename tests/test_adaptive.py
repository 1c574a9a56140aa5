from tracewell.operators import adaptive


def test_rules_fire_once_per_sentence_and_not_when_negated(spark):
    text = (
        "Adaptive Applications run on top of ARA. The SM is commanding the Execution Management. "
        "Communication Management provides the ara::com service interface. EM interacts with SM. PHM does not interact with DM. "
        "UCM updates a Software Package. Clusters of the Adaptive Platform Service are many. Persistency belongs to the Adaptive Platform Foundation. EM is configured in the Machine Manifest."
    )
    chunks = spark.createDataFrame([(1, text), (2, None), (3, "")], "chunk_id long, text string")
    got = {(r.subject.split(":")[-1], r.predicate, r.object.split(":")[-1]) for r in adaptive.relations(chunks).collect()}
    assert got == {
        ("adaptive_application", "runs_on", "ara"),
        ("state_management", "commands", "execution_management"),
        ("communication_management", "provides_interface", "ara_com_service_interface"),
        ("execution_management", "interacts_with", "state_management"),
        ("update_and_configuration_management", "updates", "software_package"),
        ("persistency", "belongs_to", "adaptive_platform_foundation"),
        ("persistency", "belongs_to", "adaptive_platform_services"),
        ("communication_management", "uses_interface", "ara_com_service_interface"),  # the word alone is a trigger
        ("execution_management", "configured_by", "machine_manifest"),
    }
    kinds = {r.entity_key: r.n_mentions for r in adaptive.entities(chunks).collect()}
    assert kinds["autosar:functional_cluster:execution_management"] == 3 and kinds["autosar:manifest:machine_manifest"] == 1


def test_the_services_side_needs_its_entity(spark):
    chunks = spark.createDataFrame([(1, "Persistency belongs to the Adaptive Platform Foundation.")], "chunk_id long, text string")
    assert {r.object.split(":")[-1] for r in adaptive.relations(chunks).collect()} == {"adaptive_platform_foundation"}
