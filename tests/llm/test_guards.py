"""What is looked for before a pattern never hides what the pattern finds, and the patterns run behind it."""

from pyspark.sql import functions as F
from quillspark.llm import quality, secrets


def test_boilerplate_is_found_behind_its_parts(spark):
    lines = ["ALL Rights Reserved", "our Cookies and their policy", "Terms of Service", "Privacy POLICY", "enable javascript", "Lorem ipsum", "Click here", "subscribe to our", "licensed under", "Copyright 2020", "Alle Rechte vorbehalten", "Datenschutzerklärung", "Nutzungsbedingungen", "klicken Sie hier", "Newsletter abonnieren", "Tous droits réservés", "politique de confidentialité", "Conditions d'utilisation", "cliquez ici", "abonnez-vous", "todos los derechos reservados", "Política de privacidad", "condiciones de uso", "haga clic aquí", "Suscríbase"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    assert df.filter(F.col("x").rlike(quality.BOILERPLATE)).count() == len(lines) == len(quality.BOILERPLATE_PARTS)
    assert df.filter(quality.holds_any(F.col("x"), quality.BOILERPLATE_PARTS)).count() == len(lines)


def test_secret_texts_are_found_behind_their_parts(spark):
    key = "secret token passw passphrase pwd api_key API-KEY accesskey private-key x_key auth Bearer credential signing".split()
    said = "password passphrase passcode passwd pwd secret token key apikey credentials passwort kennwort passe contraseña clave".split()
    texts = [f"{k}: x" for k in key] + [f"{k}=x" for k in key] + [f"the {k.title()} is x1" for k in said] + ["a://u:p@h", "x" * 16]
    df = spark.createDataFrame([(x,) for x in [*texts, "plain: text", None]], "x string")
    assert df.filter(secrets._may_hold(F.col("x"))).count() == len(texts)
